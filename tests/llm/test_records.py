"""Record files: exact round trip, public checksum vectors, damage, odd rows."""

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import records
from tallyframe.llm.queries import QUERIES
from tallyframe.sources.files import load

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def folder(spark):
    return records.new_folder(spark)


def files_of(folder):
    return sorted(Path(folder.removeprefix("file:"), "records").glob("part-*"))


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    # Published values of CRC-32C.
    known = {b"123456789": 0xE3069283, bytes(32): 0x8A9136AA, b"\xff" * 32: 0x62A8AB43, b"": 0}
    assert records.crc32c(list(known)).tolist() == list(known.values())
    draw = random.Random(3)
    parts = [draw.randbytes(n) for n in [0, 1, 63, 64, 65, 127, 128, 1000, 4097, *range(40)]]
    assert records.crc32c(parts).tolist() == [slow_crc32c(p) for p in parts]
    assert records.masked(np.array([0], np.uint32)).tolist() == [0xA282EAD8]


def test_op12_records(spark, data_dir):
    from tokenizers import Tokenizer

    docs = load(spark, data_dir, "documents").toPandas().sort_values("doc_id")
    ours = QUERIES["op12_records"](spark, data_dir).toPandas().set_index("doc_id")
    tokenizer = Tokenizer.from_file(PATH)
    made = tokenizer.encode_batch(docs.text.fillna("").tolist(), add_special_tokens=False)
    before = 0
    assert len(ours) == len(docs)
    for doc, encoded in zip(docs.doc_id, made):
        ids = np.array([*encoded.ids, 2], "<u4")
        assert tuple(ours.loc[doc, ["start", "n_tokens", "ids_crc32"]]) == (
            before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


def test_many_files_and_shuffled_reads(spark, data_dir, folder):
    docs = load(spark, data_dir, "documents")
    records.write_records(docs, folder, PATH, 2, file_bytes=20_000)
    records.write_index(spark, folder)
    index = records.read_index(spark, folder).toPandas()
    assert index.file.nunique() > 5
    ordered = index.sort_values(["file", "offset"])
    assert (ordered.id.diff().dropna() > 0).all()
    assert (ordered.start.values == np.concatenate([[0], ordered.n_tokens.cumsum()[:-1]])).all()
    # The files alone, read by another program, hold what the index says.
    whole = b""
    for path in files_of(folder):
        data = path.read_bytes()
        for _, sizes, _, ids in records.parsed(data, path.name):
            whole += b"".join(ids)
        assert len(data) == index[index.file == int(path.name.split("-")[1])]["size"].sum()
    assert len(whole) == 4 * index.n_tokens.sum()
    some = spark.createDataFrame(index.sample(40, random_state=1))
    fetched = {r["id"]: r for r in records.read_at(spark, folder, some).collect()}
    assert len(fetched) == 40
    for row in index.itertuples():
        if row.id in fetched:
            assert fetched[row.id]["ids"] == whole[4 * row.start:4 * (row.start + row.n_tokens)]


def test_every_byte_and_odd_rows(spark, folder):
    rows = [
        (5, None, "x"), (3, "", "x"), (None, "without id", None), (3, "again", "x"), (3, "again", "x"),
        (-7, "\n\r\x00 line feeds   é 漢字", "x"), (9, "word " * 50_000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    records.write_records(docs, folder, PATH, 2, file_bytes=64)
    records.write_index(spark, folder)
    index = [tuple(r)[:1] + (r["n_tokens"],) for r in records.read_index(spark, folder).orderBy("start").collect()]
    assert [i for i, _ in index] == [None, -7, 3, 3, 3, 5, 9]
    assert sorted(n for i, n in index if i == 3) == [1, 2, 2] and index[5] == (5, 1) and index[6] == (9, 50_001)


def test_one_id_spreads_over_files(spark, folder):
    docs = spark.range(400).select(F.lit(1).alias("doc_id"), F.lit("the same text").alias("text"))
    records.write_records(docs, folder, PATH, 2, file_bytes=1_000)
    sizes = [p.stat().st_size for p in files_of(folder)]
    assert len([s for s in sizes if s]) >= 4 and max(sizes) < sum(sizes) / 2


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string")
    records.write_records(docs, folder, PATH, 2)
    records.write_index(spark, folder)
    assert records.read_index(spark, folder).collect() == []


@pytest.mark.parametrize("width", [2, 4])
def test_damage_is_found(width):
    ids = [np.array(i, "<u4").tobytes() for i in ([7, 65_535], [], [10, 2570, 0])]
    made = b"".join(f + b"\n" for f in records.frames([1, None, 3], ids, width))
    found = [part for part in records.parsed(made, "f")]
    assert found[0][2:] == ([1, None, 3], ids)
    for at in range(len(made)):
        broken = bytearray(made)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            list(records.parsed(bytes(broken), "f"))
    with pytest.raises(ValueError, match="cut off"):
        list(records.parsed(made[:-1], "f"))
