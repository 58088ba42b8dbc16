"""Table scans, CSV scans, declared schemas, writers and staged tables."""

from tallyframe.sources.files import (  # noqa: F401
    catalog,
    catalog_columns,
    catalog_keys,
    catalog_tables,
    load,
    read_bucketed,
    read_csv,
    read_dataset,
    write_bucketed,
    write_dataset,
)
from tallyframe.sources.staging import staged  # noqa: F401
