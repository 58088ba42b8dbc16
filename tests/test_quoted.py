"""CSV files with line breaks in quoted cells, cut into many splits."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.sources import quoted, read_csv

SCHEMA = (
    StructType().add("id", "integer").add("note", "string").add("price", "double")
    .add("seen", "timestamp_ntz").add("last", "string")
)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def one_task_reader(spark, path):
    """Spark's reader, which reads a whole file in one task."""
    return (
        spark.read.schema(SCHEMA).option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").option("quote", '"').option("escape", '"').option("multiLine", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    )


def cell(draw, longest):
    parts = ['""', "\n", ",", "x", "é漢", " ", "\n\n", "word", "\\", "'", ";"]
    return '"' + "".join(draw.choice(parts) for _ in range(draw.randrange(longest))) + '"'


def write(path, rows, draw, end="\n", longest=40):
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("id,note,price,seen,last" + end)
        for i in range(rows):
            note = cell(draw, longest) if draw.random() < 0.7 else draw.choice(["plain", "", "two words"])
            last = cell(draw, 8) if draw.random() < 0.3 else "z"
            out.write(f"{i},{note},{draw.choice(['', '1.5', '-2'])},2024-01-{1 + i % 28:02d} 10:00:00,{last}{end}")
            if draw.random() < 0.05:
                out.write(end)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_equal_those_of_one_task(spark, tmp_path, small_splits, end):
    draw = random.Random(11)
    for number in range(3):
        write(tmp_path / f"f{number}.csv", 150, draw, end)
    ours = read_csv(spark, str(tmp_path), SCHEMA)
    assert ours.rdd.getNumPartitions() > 40
    found = rows_of(ours)
    assert len(found) == 450
    assert found == rows_of(one_task_reader(spark, str(tmp_path)))


def test_a_cell_longer_than_several_splits(spark, tmp_path, small_splits):
    long = "line, \n" * 700 + '""end""\n'
    (tmp_path / "a.csv").write_text(
        f'id,note,price,seen,last\n1,"{long}",1.0,,a\n2,"{long}",2.0,,"b\nc"\n3,short,,,"{long}"', encoding="utf-8")
    splits = quoted.find_splits(spark, str(tmp_path))
    assert len(splits.broken) == 1 and len(splits.inside) > 20
    whole = long.replace('""', '"')
    assert rows_of(read_csv(spark, str(tmp_path), SCHEMA)) == [
        (1, whole, 1.0, None, "a"), (2, whole, 2.0, None, "b\nc"), (3, "short", None, None, whole)]


def test_only_files_with_such_cells_leave_sparks_reader(spark, tmp_path):
    write(tmp_path / "a.csv", 20, random.Random(1))
    (tmp_path / "b.csv").write_text('id,note,price,seen,last\n7,"a ""q"", b",,,\n', encoding="utf-8")
    splits = quoted.find_splits(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in splits.plain + splits.broken] == ["b.csv", "a.csv"]
    assert rows_of(read_csv(spark, str(tmp_path), SCHEMA)) == rows_of(one_task_reader(spark, str(tmp_path)))
    alone = read_csv(spark, str(tmp_path / "b.csv"), SCHEMA)
    assert "MapInArrow" not in alone._jdf.queryExecution().executedPlan().toString()


def test_faults_raise(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,note,price,seen,last\n1,"never closed,,,\n2,b,,,\n')
    with pytest.raises(ValueError, match="not closed"):
        read_csv(spark, str(tmp_path / "open.csv"), SCHEMA)
    (tmp_path / "header.csv").write_text('id,price,note,seen,last\n1,"a\nb",,,\n')
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path / "header.csv"), SCHEMA).collect()
    (tmp_path / "cell.csv").write_text('id,note,price,seen,last\none,"a\nb",,,\n')
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "cell.csv"), SCHEMA).collect()
    (tmp_path / "empty.csv").write_text('id,note,price,seen,last\n')
    assert read_csv(spark, str(tmp_path / "empty.csv"), SCHEMA).collect() == []


def test_header_with_a_line_break(spark, tmp_path, small_splits):
    schema = StructType().add("a\nb", "integer").add("c", "string")
    (tmp_path / "a.csv").write_text('"a\nb",c\n1,"x\ny"\n')
    assert rows_of(read_csv(spark, str(tmp_path), schema)) == [(1, "x\ny")]


def test_columns_are_still_pruned(spark, tmp_path):
    write(tmp_path / "a.csv", 50, random.Random(2))
    assert read_csv(spark, str(tmp_path), SCHEMA).agg(F.sum("id")).first()[0] == 49 * 25


def test_files_without_such_cells_beside_large_ones(spark, tmp_path):
    """Splits follow from all files of a scan, and the plain ones are not in every scan."""
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "7")
    try:
        write(tmp_path / "a.csv", 400, random.Random(5))
        write(tmp_path / "b.csv", 300, random.Random(6))
        (tmp_path / "c.csv").write_text("id,note,price,seen,last\n" + "7,plain,,,z\n" * 2000)
        ours = read_csv(spark, str(tmp_path), SCHEMA)
        found = rows_of(ours)
        # The cores there are, and with them the splits, may change before the rows are read.
        spark.conf.set("spark.sql.files.minPartitionNum", "19")
        again = rows_of(ours.where("id >= 0"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(found) == 2700
    assert found == again == rows_of(one_task_reader(spark, str(tmp_path)))


def test_records_cut_by_chunks(monkeypatch):
    monkeypatch.setattr(quoted, "CHUNK_BYTES", 50)
    draw = random.Random(8)
    records = [f"{i},{cell(draw, 40)}" if i % 3 else f"{i},plain" for i in range(200)]
    lines = "\n".join(records).split("\n")
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(["f"] * len(part)), pa.array([0] * len(part)), pa.array(part)],
            names=["file", "split", "value"])
        for at in range(0, len(lines), 70) for part in [lines[at:at + 70]]
    ]
    written = [row for b in quoted.chunks(iter(batches)) for row in b.to_pylist()]
    assert "\n".join(w["text"] for w in written) == "\n".join(lines)
    assert [w["number"] for w in written] == list(range(len(written))) and len(written) > 50
    made = []
    for w in written:
        at = (w["file"], w["split"], w["number"])
        for row in quoted.fragments(at, bool(w["before"]), w["text"]).to_pylist():
            if row["kind"] in (quoted.TAIL, quoted.THROUGH):
                made[-1] += "\n" + row["record"]
            else:
                made.append(row["record"])
    assert made == records
