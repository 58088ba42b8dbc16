"""Intermediate tables that several passes read.

A plan that scans the same join or deduplication more than once writes it to
the shared folder first.  The copy is columnar, so each pass reads only its
columns, and it outlives any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a private one only in local mode."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="tallyframe-")
    return _own_folder[app]


def staged(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` once, with options of the writer, and return a scan of the written table."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/{app}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, column: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once, dealt to buckets by a column, and return a scan that knows it.

    Joins and groupings by that column read the buckets as they lie; of a join
    only the other side moves.  The catalog entry that the writer needs is
    dropped at once, the files stay.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = f"{label}-{uuid.uuid4().hex}"
    name = f"staged_{label.replace('-', '_')}"
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}"
    (
        df.repartition(buckets, column).write.format("parquet").option("path", path)
        .bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    )
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def release(spark: SparkSession) -> None:
    """Delete the staged tables of this application once their results are taken."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    )
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path, True)
    spark.catalog.clearCache()
