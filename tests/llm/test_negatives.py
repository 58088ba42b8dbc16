"""Hard negatives against plain search over all rows."""

import numpy as np
from compare import assert_same
from pyspark.sql import functions as F

from tallyframe.llm import negatives
from tallyframe.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, key string, cell string"


def plain(rows, every, positives=5, count=3, low=50, high=95):
    """Sorted output rows; every row is a row of its own."""
    width = max((len(x) for _, x, _ in rows), default=0)
    able = [
        (i, [int(np.floor(256 * np.float64(np.float32(v)))) for v in x] + [0] * (width - len(x)), label)
        for i, x, label in rows
    ]
    out = []
    for at, (anchor, q, label) in enumerate(able):
        if anchor % every:
            continue
        score = [(-sum(a * b for a, b in zip(q, x)), i, k) for k, (i, x, _) in enumerate(able)]
        mine = sorted(s for s in score if s[2] != at and able[s[2]][2] == label)[:positives]
        for p, positive, _ in mine:
            fit = sorted(s for s in score if able[s[2]][2] != label and low * -p <= 100 * -s[0] <= high * -p)
            out += [(anchor, positive, r, i, -p, -s) for r, (s, i, _) in enumerate(fit[:count], 1)]
    return sorted(out)


def check(spark, rows, every, **sizes):
    table = spark.createDataFrame(
        [(i, [float(v) for v in x], label, "clash", None) for i, x, label in rows], SCHEMA)
    ours = negatives.hard_negatives(table, F.col("label"), F.col("vec_id") % every == 0, **sizes)
    found = sorted(tuple(r) for r in ours.collect())
    expected = plain(rows, every)
    assert found == expected
    return len(expected)


def test_matches_sql(spark, duck, data_dir):
    assert assert_same(QUERIES["op13_negatives"](spark, data_dir), duck, ORACLE_SQL["op13_negatives"])


def test_many_cells_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELL_ROWS", 30)
    monkeypatch.setattr(negatives, "LEAF", 8)
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 2, (12, 6))
    rows = [(i, np.float32(middles[i % 12] + rng.normal(0, 0.4, 6)), i % 12 % 5) for i in range(900)]
    assert check(spark, rows, 20, block=40) > 200


def test_hot_copies_and_ties(spark):
    # A third of all rows is one vector under two labels; scores tie everywhere.
    rows = [
        (i, [1, 1, 0] if i % 3 == 0 else [i % 5 * 0.25, i % 4 * 0.5, -(i % 2)], i % 2 + (i % 11 == 0))
        for i in range(300)
    ]
    assert check(spark, rows, 25, block=32)


def test_lengths_repeats_and_signs(spark):
    rows = [
        (0, [], 1), (0, [1.0], 1), (0, [1.0], 1), (1, [0.5, -3.0], 2), (2, [-1.0, 2.0, 4.0], 1),
        (3, [0.75], 2), (4, [0.9, 9.0], 2), (5, [-0.5], 1), (6, [0.6], 0), (50, [2.0, 0.1], 2), (51, [1.5], 1),
    ]
    assert check(spark, rows, 50)


def test_rows_that_take_no_part(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 1.0], 1, "x", None), (1, [1.0, 0.9], 1, "x", None), (2, [0.5, 0.6], 2, "x", None),
        (3, None, 1, "x", None), (4, [nan, 9.0], 1, "x", None), (5, [None, 9.0], 1, "x", None),
        (6, [9.0, 9.0], None, "x", None), (None, [9.0, 9.0], 1, "x", None), (50, [float("inf"), 1.0], 2, "x", None),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    ours = negatives.hard_negatives(table, F.col("label"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["anchor_id"], r["positive_id"], r["negative_id"]) for r in ours] == [(0, 1, 2)]
    empty = negatives.hard_negatives(table.where("false"), F.col("label"), F.lit(True))
    assert empty.collect() == [] and empty.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.float32(rng.normal(0, 1e5, 4)), i % 3) for i in range(120)]
    assert check(spark, rows, 30)


def test_tree_covers_and_leaves_out():
    rng = np.random.default_rng(6)
    middles = rng.normal(0, 30, (16, 4))
    points = middles[np.arange(2000) % 16] + rng.normal(0, 0.5, (2000, 4))
    tree = negatives.cover_tree(points, 32)
    leaves = np.concatenate([rows for _, _, children, rows in tree if not children])
    assert sorted(leaves) == list(range(2000))

    def below(node):
        _, _, children, rows = tree[node]
        return np.concatenate([below(c) for c in children]) if children else rows

    for node, (centre, radius, _, _) in enumerate(tree):
        away = np.sqrt(((points[below(node)] - points[centre]) ** 2).sum(axis=1))
        assert away.max() <= radius + 1e-9
    x = np.floor(points * 256).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    block = negatives.Block(np.arange(2000), np.arange(2000), np.zeros(2000, np.int64), x, most)
    seen = []
    scores = x @ x[5]
    least = int(np.sort(scores)[-40])
    block.descend(x[5], lambda low, high: high >= least, lambda run, s: seen.extend(s.tolist()))
    assert sorted(seen)[-40:] == np.sort(scores)[-40:].tolist() and len(seen) < 1500
