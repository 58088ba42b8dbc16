"""Reading and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyframe.sources import quoted
from tallyframe.sources.schemas import TableKeys


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one Parquet table of a directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """Scan CSV files with a header under a declared schema.

    The schema replaces inference.  Columns of timestamp type are parsed while
    reading; a mixed column is declared as string and split later.  Malformed
    cells raise instead of turning into null, and so does a header that names
    other columns or another order.  Quotes inside a quoted cell are doubled, and
    quoted cells may hold line breaks: large files are split all the same (see
    ``quoted``).  One scan that only counts quotes runs when this is called; files
    with line breaks in cells are then staged as chunks of lines.
    """
    options = {
        "quote": '"', "escape": '"',
        "timestampFormat": timestamp_format, "timestampNTZFormat": timestamp_format,
    }
    splits = quoted.find_splits(spark, path)

    def plain(paths: str | list[str]) -> DataFrame:
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        return reader.option("mode", "FAILFAST").options(**options).csv(paths)

    if not splits.broken:
        return plain(path)
    found = quoted.records(spark, splits.broken)
    broken = quoted.parsed(found, schema, {**options, "multiLine": "true"})
    return plain(splits.plain).unionByName(broken) if splits.plain else broken


def write_dataset(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Hand a prepared table over as Parquet, optionally partitioned for pruning.

    The rows are first clustered by the partition columns plus all other columns'
    natural split: AQE's rebalance keeps files evenly sized even when one
    partition value holds most of the rows.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bucketed(df: DataFrame, path: str, column: str, buckets: int) -> None:
    """Hand a prepared table over as Parquet, dealt to sorted buckets by a column.

    One file per bucket.  Rows of one key lie together, so the table should hold
    few rows per key.  A folder that holds files already is refused.
    """
    name = _entry()
    writer = df.repartition(buckets, column).write.format("parquet").option("path", path)
    writer.bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_bucketed(
    spark: SparkSession, path: str, schema: StructType, column: str, buckets: int
) -> DataFrame:
    """A scan of ``write_bucketed``'s files that knows their buckets, in any session.

    Joins and groupings by the column read the buckets as they lie.  The catalog
    entry that tells the planner so is dropped at once; the files stay.
    """
    name = _entry()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{column}`) "
        f"SORTED BY (`{column}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def _entry() -> str:
    return f"handed_{uuid.uuid4().hex}"


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of a schema, one row each."""
    rows = [
        (t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)
    ]
    return spark.createDataFrame(
        rows, "table_name string, table_type string, is_temporary boolean"
    )


def catalog_columns(df: DataFrame, table_name: str, table_schema: str = "default") -> DataFrame:
    """Column names and types of a table in declared order."""
    rows = [
        (table_schema, table_name, i, f.name, f.dataType.simpleString())
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "table_schema string, table_name string, position int, column_name string, data_type string"
    )


def catalog_keys(
    spark: SparkSession, keys: Mapping[str, TableKeys], table_schema: str = "default"
) -> DataFrame:
    """Declared keys, one row per column and constraint; foreign ones name their parent."""
    rows = [
        (table_schema, table, column, "primary key", None, None)
        for table, declared in keys.items() for column in declared.primary
    ] + [
        (table_schema, table, column, "foreign key", *parent)
        for table, declared in keys.items() for column, parent in declared.foreign.items()
    ]
    return spark.createDataFrame(
        rows, "table_schema string, table_name string, column_name string, key_role string, "
        "parent_table string, parent_column string"
    )


def catalog(
    tables: Mapping[str, DataFrame], keys: Mapping[str, TableKeys], table_schema: str = "default"
) -> DataFrame:
    """Columns of several tables with their keys, joined by schema, table and column.

    A column under two constraints has two rows, one without any has an empty role.
    """
    columns = reduce(
        DataFrame.unionByName, [catalog_columns(df, name, table_schema) for name, df in tables.items()]
    )
    declared = catalog_keys(columns.sparkSession, keys, table_schema)
    return columns.join(declared, ["table_schema", "table_name", "column_name"], "left")
