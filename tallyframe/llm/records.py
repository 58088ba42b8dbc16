"""Token sequences as length-delimited binary records with a separate offset index.

A record file is a run of frames, each one sequence:

    length of the body, 64 bits | masked checksum of these 8 bytes, 32 bits
    body: 1 or 0 (has an id), 16 bits | bytes per token id, 16 bits | id, 64 bits | token ids
    masked checksum of the body, 32 bits | one line feed

All numbers are little-endian.  Token ids take two bytes where the vocabulary
allows it, else four.  Checksums are CRC-32C, masked so that a checksum
over data that hold checksums stays strong.  The line feed is the separator of
Spark's text writer, which writes the frames: files appear through its commit
protocol on whatever file system the folder names, and a lost executor leaves no
half file.  Lengths, not separators, delimit frames, so ids may hold any byte.

Rows are range-partitioned by id (ties: a hash of the text, then the row's
place, so that no id can crowd one file) and sorted within files, so file and
place order is id order.  The index has a row per sequence: file, offset, size,
ids before it.  Readers fetch records by offset in any order.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyframe.llm.common import kept_in_worker, slices
from tallyframe.llm.tokens import WordIds
from tallyframe.sources.staging import shared_folder

REMEMBERED = 800_000
FILE_BYTES = 32 << 20  # of text a file; its ids take about as much
CHUNK = 128
PARSED_BYTES = 2 << 20
END = b"\n"
# Length and its checksum; the body's flag, width and id; the body's checksum.
HEAD, BODY, TAIL = "<QI", "<HHq", "<I"
HEAD_BYTES, BODY_BYTES, TAIL_BYTES = 12, 12, 4

# The reflected polynomial of CRC-32C and the constant of the mask.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8


_tables: dict[int, np.ndarray] = {}  # maps by level; under -1 and -2 the steps of one and two bytes


def _byte_table() -> np.ndarray:
    if -1 not in _tables:
        _tables[-1] = _made_byte_table()
    return _tables[-1]


def _made_byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _applied(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, held as one table per byte."""
    out = tables[0][values & 255]
    for i in (1, 2, 3):
        out = out ^ tables[i][(values >> np.uint32(8 * i)) & 255]
    return out


def _word_table() -> np.ndarray:
    if -2 not in _tables:
        _tables[-2] = _applied(_zeros(1), np.arange(1 << 16, dtype=np.uint32))
    return _tables[-2]


def _zeros(level: int) -> np.ndarray:
    """The map of a checksum register that is fed 2**level zero bytes."""
    if level not in _tables:
        _tables[level] = _made_zeros(level)
    return _tables[level]


def _made_zeros(level: int) -> np.ndarray:
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if level == 0:
        images = _byte_table()[bits & 255] ^ (bits >> 8)
    else:
        half = _zeros(level - 1)
        images = _applied(half, _applied(half, bits))
    chosen = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([
        np.bitwise_xor.reduce(np.where(chosen, images[8 * i:8 * i + 8], 0), axis=1) for i in range(4)
    ]).astype(np.uint32)


def _fed(values: np.ndarray, zeros: np.ndarray, level: int) -> np.ndarray:
    """Registers fed ``zeros * 2**level`` zero bytes each."""
    values, left = values.copy(), zeros.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        values[odd] = _applied(_zeros(level), values[odd])
        left >>= 1
        level += 1
    return values


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part.

    The checksum is linear: all chunks of all parts run side by side, and each is
    then fed as many zero bytes as follow it in its part.
    """
    if not parts:
        return np.empty(0, np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    chunks = np.maximum(1, -(-sizes // CHUNK))
    ends = chunks.cumsum()
    flat = np.zeros(int(ends[-1]) * CHUNK, np.uint8)
    for end, part in zip((ends * CHUNK).tolist(), parts):
        flat[end - len(part):end] = np.frombuffer(part, np.uint8)
    table, crc = _word_table(), np.zeros(int(ends[-1]), np.uint32)
    for column in np.ascontiguousarray(flat.view("<u2").reshape(-1, CHUNK // 2).T):
        crc = table[(crc ^ column) & 0xFFFF] ^ (crc >> 16)
    following = np.repeat(ends, chunks) - 1 - np.arange(len(crc))
    whole = np.bitwise_xor.reduceat(_fed(crc, following, CHUNK.bit_length() - 1), ends - chunks)
    return whole ^ _fed(np.full(len(parts), 0xFFFFFFFF, np.uint32), sizes, 0) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def resized(ids: bytes, old: int, new: int) -> bytes:
    return ids if old == new else np.frombuffer(ids, f"<u{old}").astype(f"<u{new}").tobytes()


def frames(keys: list[int | None], ids: list[bytes], width: int = 4) -> list[bytes]:
    """Frames without their separator, of ids of four bytes each."""
    bodies = [
        struct.pack(BODY, k is not None, width, k or 0) + resized(i, 4, width) for k, i in zip(keys, ids)
    ]
    lengths = [struct.pack("<Q", len(b)) for b in bodies]
    sums = masked(crc32c(lengths)).tolist(), masked(crc32c(bodies)).tolist()
    return [
        b"".join((n, struct.pack(TAIL, first), body, struct.pack(TAIL, last)))
        for n, first, body, last in zip(lengths, sums[0], bodies, sums[1])
    ]


def parsed(data: bytes, name: str, at: int = 0, until: int | None = None):
    """Lists (offset, size, key, ids of four bytes), a few megabytes at a time; all checksums are verified."""
    until = len(data) if until is None else until
    while at < until:
        offsets, bodies, lengths, sums, held = [], [], [], [], 0
        while at < until and held < PARSED_BYTES:
            if until - at < HEAD_BYTES:
                raise ValueError(f"{name}: frame cut off at {at}")
            length, first = struct.unpack_from(HEAD, data, at)
            stop = at + HEAD_BYTES + length
            if stop + TAIL_BYTES + len(END) > until:
                raise ValueError(f"{name}: frame cut off at {at}")
            offsets.append(at)
            lengths.append(data[at:at + 8])
            bodies.append(data[at + HEAD_BYTES:stop])
            sums.append((first, *struct.unpack_from(TAIL, data, stop)))
            if data[stop + TAIL_BYTES:stop + TAIL_BYTES + len(END)] != END:
                raise ValueError(f"{name}: no end of frame at {stop + TAIL_BYTES}")
            held += length
            at = stop + TAIL_BYTES + len(END)
        found = np.stack([masked(crc32c(lengths)), masked(crc32c(bodies))], axis=1)
        wrong = np.flatnonzero((found != np.array(sums, np.uint32)).any(axis=1))
        if len(wrong):
            raise ValueError(f"{name}: wrong checksum in the frame at {offsets[wrong[0]]}")
        keys = [struct.unpack_from(BODY, b) for b in bodies]
        yield (
            offsets, [HEAD_BYTES + len(b) + TAIL_BYTES + len(END) for b in bodies],
            [k if known else None for known, _, k in keys],
            [resized(b[BODY_BYTES:], width, 4) for b, (_, width, _) in zip(bodies, keys)],
        )


def word_ids(path: str, end_id: int | None) -> WordIds:
    """The encoder of a worker, whose memory stays small over all of its tasks."""
    return WordIds(path, end_id, REMEMBERED)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/records-{uuid.uuid4().hex}"


def write_records(
    docs: DataFrame, folder: str, path: str, end_id: int | None, key: str = "doc_id",
    column: str = "text", file_bytes: int = FILE_BYTES,
) -> None:
    """Tokenize and write one record per row to ``folder``/records, in ascending order of ``key``.

    A null text is an empty one.  Rows without id come first.  Rows that repeat
    an id are records of their own, in an order that their texts decide.
    """
    rows = docs.select(
        docs[key].cast("long").alias("id"), docs[column].cast("string").alias("text"),
        F.xxhash64(docs[column].cast("string")).alias("tie"), F.monotonically_increasing_id().alias("row"),
    )
    size = docs.agg(F.sum(F.octet_length(docs[column].cast("string")))).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), "tie", "row"]
    sorted_rows = rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)

    def frame(batches):
        encode = kept_in_worker(("word ids", path, end_id), lambda: word_ids(path, end_id))
        most = max(encode.pieces.encoder.get_vocab_size(), 1 + (end_id or 0))
        width = 2 if most <= 1 << 16 else 4
        for batch in batches:
            for part in slices(batch, "text"):
                made = frames(part.column("id").to_pylist(), encode(part.column("text").to_pylist()), width)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["frame"])

    framed = sorted_rows.select("id", "text").mapInArrow(frame, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", END.decode()
    ).text(f"{folder}/records")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("path", r"/part-([0-9]+)", 1).cast("long")
    return spark.read.format("binaryFile").load(f"{folder}/records").select(
        number.alias("file"), "content"
    )


RECORD = "file long, offset long, size long, id long, n_tokens long, ids binary"


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the files with their places; a damaged frame raises."""
    kinds = list(to_arrow_schema(StructType.fromDDL(RECORD)).types)
    names = StructType.fromDDL(RECORD).fieldNames()

    def read(batches):
        for batch in batches:
            for number, data in zip(batch.column("file"), batch.column("content")):
                number = number.as_py()
                for offsets, sizes, keys, ids in parsed(data.as_py(), f"file {number}"):
                    values = [[number] * len(ids), offsets, sizes, keys, [len(i) // 4 for i in ids], ids]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, k) for v, k in zip(values, kinds)], names=names
                    )

    return _files(spark, folder).mapInArrow(read, RECORD)


def write_index(spark: SparkSession, folder: str) -> None:
    """Read all records back and write ``folder``/index, a row per record.

    ``start`` counts the ids of all records before it: those of its file by the
    files' totals, which are few, and those within the file in offset order.
    """
    scan_records(spark, folder).select(
        "file", "offset", "size", "id", "n_tokens", F.crc32("ids").alias("ids_crc32")
    ).write.parquet(f"{folder}/places")
    places = spark.read.parquet(f"{folder}/places")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    totals = places.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    places.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(
        totals, "file"
    ).select(
        "id", "file", "offset", "size", (F.col("base") + F.col("within")).alias("start"),
        "n_tokens", "ids_crc32",
    ).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records at the places (file, offset, size) of ``wanted``, such as an epoch's shuffled draw.

    Each file meets the places wanted of it once; the rows of an index that fit
    one file are bounded by the file's size.
    """

    def cut(file: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(file) and len(places):
            data, number = file["content"].iloc[0], int(file["file"].iloc[0])
            for at, size in zip(places["offset"].tolist(), places["size"].tolist()):
                for offsets, sizes, keys, ids in parsed(data, f"file {number}", at, at + size):
                    rows.append((number, offsets[0], sizes[0], keys[0], len(ids[0]) // 4, ids[0]))
        return pd.DataFrame(rows, columns=names).astype({"id": "Int64"})

    names = StructType.fromDDL(RECORD).fieldNames()
    places = wanted.select("file", "offset", "size")
    return _files(spark, folder).groupBy("file").cogroup(places.groupBy("file")).applyInPandas(cut, RECORD)
