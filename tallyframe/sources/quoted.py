"""CSV files whose quoted cells hold line breaks, read by many tasks.

A line break ends a record where the number of quotes before it, from the start
of the file on, is even.  Files are scanned as lines, which Spark splits by byte
ranges.  Where it splits depends on all files of a scan, on settings and on the
cores there are just then, so no scan relies on the splits of another.  The
lines of each split are written as chunks, with the parity of the quotes before
them in their split.  The running sum over a file's splits says which of them
begin inside a quoted cell, and with both each chunk is put together to records
by itself.  What a chunk's boundary cuts in two, at most one record per boundary,
is stitched together apart, and whole records are parsed as cells by Spark.

Files without any line of an odd number of quotes hold no such cells; they go to
Spark's own reader, which splits them too.  Files follow RFC 4180: quotes stand
in quoted cells only, doubled.  A file that ends inside a quoted cell raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tallyframe.sources.staging import staged

# A record is whole in its chunk, ends there, begins there, or runs through it.
WHOLE, TAIL, HEAD, THROUGH = range(4)
FRAGMENT = "file string, split long, number long, kind int, header boolean, record string"
CHUNK = "file string, split long, number long, before int, quotes long, text string"
CHUNK_BYTES = 256 << 10
ROW_GROUP_BYTES = 32 << 20


@dataclass
class Splits:
    """Files by whether any line has an odd number of quotes, and splits that begin in a cell."""

    plain: list[str]
    broken: list[str]
    inside: set[tuple[str, int]]


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines with the byte range they were read from, in order within it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        "value",
    )


def states(per_split: DataFrame) -> DataFrame:
    """Append to the quotes of each split whether it begins, and its file ends, inside a cell."""
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return per_split.withColumns({
        "inside": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2,
        "open": F.sum("quotes").over(Window.partitionBy("file")) % 2,
    })


def find_splits(spark: SparkSession, path: str) -> Splits:
    """One scan that counts quotes; a row per file, and those splits that begin in a cell, are collected."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    per_split = lines(spark, path).groupBy("file", "split").agg(
        F.sum(quotes).alias("quotes"), F.max(quotes % 2).alias("odd")
    )
    files = states(per_split).groupBy("file").agg(
        F.max("odd").alias("odd"), F.max("open").alias("open"),
        F.collect_list(F.when(F.col("inside") == 1, F.col("split"))).alias("inside"),
    ).collect()
    left_open = sorted(r["file"] for r in files if r["open"])
    if left_open:
        raise ValueError(f"a quoted cell is not closed at the end of {left_open[0]}")
    return Splits(
        sorted(r["file"] for r in files if not r["odd"]), sorted(r["file"] for r in files if r["odd"]),
        {(r["file"], s) for r in files for s in r["inside"]},
    )


def joined(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The lines between neighbouring bounds as one text each."""
    return pc.binary_join(pa.ListArray.from_arrays(bounds.astype(np.int32), values), "\n")


def chunks(batches):
    """Neighbouring lines of a split as one row, with the parity of the split's quotes before it."""
    at, number, before = None, 0, 0
    for batch in batches:
        names, starts, values = batch.columns
        keys = list(zip(names.to_pylist(), starts.to_pylist()))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if keys[low] != at:
                at, number, before = keys[low], 0, 0
            part = values.slice(low, high - low)
            place = np.cumsum(np.asarray(pc.binary_length(part), np.int64) + 1) // CHUNK_BYTES
            bounds = np.array([0, *(np.flatnonzero(np.diff(place)) + 1), len(part)])
            quotes = np.add.reduceat(np.asarray(pc.count_substring(part, '"'), np.int64), bounds[:-1])
            parities = (before + np.cumsum(quotes) - quotes) & 1
            count = len(quotes)
            yield pa.RecordBatch.from_arrays([
                pa.array([at[0]] * count, pa.string()), pa.array(np.full(count, at[1], np.int64)),
                pa.array(np.arange(number, number + count, dtype=np.int64)),
                pa.array(parities.astype(np.int32)), pa.array(quotes),
                joined(part, bounds).cast(pa.string()),
            ], names=["file", "split", "number", "before", "quotes", "text"])
            number, before = number + count, int(before + quotes.sum()) & 1


def fragments(at: tuple[str, int, int], inside: bool, text: str) -> pa.RecordBatch:
    """The records of one chunk, of which the first and the last may be cut."""
    values = pc.split_pattern(pa.array([text], pa.string()), "\n").flatten()
    quotes = np.asarray(pc.count_substring(values, '"'), np.int64)
    after = (np.cumsum(quotes) + inside) & 1
    bounds = np.concatenate([[0], np.flatnonzero(after == 0) + 1])
    kinds = np.full(len(bounds) - 1, WHOLE, np.int32)
    if inside and len(kinds):
        kinds[0] = TAIL
    if bounds[-1] < len(values):
        kinds = np.append(kinds, np.int32(THROUGH if inside and not len(kinds) else HEAD))
        bounds = np.append(bounds, len(values))
    count, (file, split, number) = len(kinds), at
    header = np.zeros(count, bool)
    header[0] = split == number == 0
    return pa.RecordBatch.from_arrays([
        pa.array([file] * count, pa.string()), pa.array(np.full(count, split, np.int64)),
        pa.array(np.full(count, number, np.int64)), pa.array(kinds), pa.array(header),
        joined(values, bounds).cast(pa.string()),
    ], names=["file", "split", "number", "kind", "header", "record"])


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(header, record) of files with line breaks in cells; their lines are written once as chunks."""
    written = staged(
        lines(spark, files).mapInArrow(chunks, CHUNK), "csv-chunks",
        **{"parquet.block.size": ROW_GROUP_BYTES},
    )
    per_split = written.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"))
    begun = states(per_split).where("inside = 1").select("file", "split").collect()
    held = spark.sparkContext.broadcast({tuple(r) for r in begun})  # splits that begin in a cell

    def assemble(batches):
        for batch in batches:
            for file, split, number, before, text in zip(*[c.to_pylist() for c in batch.columns]):
                inside = ((file, split) in held.value) != bool(before)
                yield fragments((file, split, number), inside, text)

    found = written.select("file", "split", "number", "before", "text").mapInArrow(assemble, FRAGMENT)
    whole = found.where(F.col("kind") == WHOLE).select("header", "record")
    # At most two fragments per chunk, of which one record begins.
    order = Window.partitionBy("file").orderBy("split", "number", "kind")
    cut = found.where(F.col("kind") != WHOLE).withColumn(
        "begun", F.sum((F.col("kind") == HEAD).cast("int")).over(
            order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("split", "number", "kind", "record")))
    stitched = cut.groupBy("file", "begun").agg(F.max("header").alias("header"), parts.alias("parts"))
    return whole.unionByName(
        stitched.select("header", F.array_join(F.col("parts.record"), "\n").alias("record"))
    )


def parsed(found: DataFrame, schema: StructType, options: dict[str, str]) -> DataFrame:
    """Records as typed rows; headers are compared with the schema's names and left out."""
    text = F.rtrim("record", F.lit("\r"))
    names = [f.name for f in schema.fields]
    wanted = ", ".join(f"`{n}` string" for n in names)
    read = F.from_csv(text, wanted, {**options, "mode": "PERMISSIVE"})
    same = F.to_json(read) == F.to_json(F.struct(*[F.lit(n).alias(n) for n in names]))
    body = found.where(
        F.when(~F.col("header"), F.trim(text) != "").when(same, False).otherwise(
            F.raise_error(F.concat(F.lit("the CSV header names other columns: "), text)).cast("boolean")
        )
    )
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return body.select(F.from_csv(text, typed, {**options, "mode": "FAILFAST"}).alias("cells")).select("cells.*")
