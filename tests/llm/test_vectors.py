"""Near-duplicate vectors: what is written and moved, odd rows against plain comparisons, bounds."""

import collections
import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import components_of

from tallyframe.llm import vectors
from tallyframe.sources import staging


def plain(rows, least):
    """(n_links, component) per row (id, vector), every pair of classes compared."""
    able, found = collections.defaultdict(list), []
    for i, v in rows:
        whole = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        found.append(tuple(float(x) + 0.0 for x in v) if whole and i is not None else None)
        if found[-1]:
            able[found[-1]].append(i)
    first, others, links = {v: min(ids) for v, ids in able.items()}, collections.Counter(), []
    for a, b in itertools.combinations(able, 2):
        if len(a) == len(b):
            x, y = np.array(a), np.array(b)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                others[first[a]] += len(able[b])
                others[first[b]] += len(able[a])
                links.append((first[a], first[b]))
    component = components_of(sorted(set(first.values())), links)
    return [
        (i, others[first[v]] + len(able[v]) - 1, component[first[v]]) if v else (i, 0, i)
        for (i, _), v in zip(rows, found)
    ]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_vectors_are_written_once_and_pairs_move_nothing(spark, monkeypatch):
    """Disk in proportion to the vectors: no copy of a block for every block that it meets."""
    draw = np.random.default_rng(3)
    whole = draw.normal(size=(6000, 64)).astype(np.float32)
    whole[3000:3100] = whole[0] + draw.normal(size=(100, 64)).astype(np.float32) / 100
    table = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(whole)], "vec_id long, embedding array<float>"
    )
    plans = {}

    def spy(df, label, **options):
        out = staging.staged(df, label, **options)
        plans[label] = df, out
        return out

    monkeypatch.setattr(vectors, "staged", spy)
    found = {r.vec_id: r for r in vectors.near_vectors(table, tile=256).collect()}
    assert {i for i, r in found.items() if r.n_links} == {0, *range(3000, 3100)}
    assert all(found[i].component_id == 0 and found[i].n_links == 100 for i in range(3000, 3100))
    # The comparison of pairs has no exchange at all.
    assert "Exchange" not in plans["vector-links"][0]._jdf.queryExecution().executedPlan().toString()
    written = sum(
        Path(f.removeprefix("file:")).stat().st_size for _, out in plans.values() for f in out.inputFiles()
    )
    assert written < 2 * whole.nbytes


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors_against_plain_comparisons(spark, kind):
    """Copies, ids that repeat, lengths mixed within a batch, zeros of either sign, no values."""
    draw = np.random.default_rng(11)
    rows = []
    for i in range(240):
        width = [2, 3, 1, 3][i % 4]
        v = draw.integers(-4, 5, width).astype(float) * [1, 2, 0.25][i % 3]
        rows.append((int(draw.integers(0, 150)) if i % 9 else i, [float(x) for x in v]))
    rows += [rows[3], (7, [-0.0, 3.0]), (9, [0.0, 3.0]), (None, [1.0, 2.0]), (None, None), (300, None), (301, [])]
    rows += [(302, [0.0, -0.0]), (303, [float("nan"), 1.0]), (304, [float("inf"), 1.0]), (305, [None, 1.0])]
    rows += [(-5, [3.0, 4.0, 0.0]), (-(2**62), [1e-30, 0.0]), (306, [1e30, 1e30])]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    as_stored = [(r.vec_id, r.embedding) for r in table.collect()]
    for tile in (8192, 16):
        ours = vectors.near_vectors(table.repartition(3), tile=tile).select("vec_id", "n_links", "component_id")
        assert in_order(ours.collect()) == in_order(plain(as_stored, 0.9)), tile


def test_many_copies(spark):
    """Far fewer vectors than rows: they are merged before blocks are made, by whatever batches they come."""
    table = spark.range(20_000, numPartitions=7).select(
        F.col("id").alias("vec_id"),
        F.array(F.cos(F.col("id") % 40 / 6.0), F.sin(F.col("id") % 40 / 6.0)).alias("embedding"),
    )
    some = [(r.vec_id, r.embedding) for r in table.where("vec_id < 40").collect()]
    few = {i: (n, c) for i, n, c in plain(some, 0.9)}
    for r in vectors.near_vectors(table, tile=8).collect():
        n, c = few[r.vec_id % 40]
        assert (r.n_links, r.component_id) == (500 * (n + 1) - 1, c)


def test_bounds_never_give_up_a_link():
    """Every number of leading dimensions gives the same pairs, those of whole numbers at the threshold too."""
    draw = np.random.default_rng(5)
    middles = draw.normal(size=(12, 24)) * np.geomspace(3, 0.01, 24)
    stored = np.concatenate([
        middles[draw.integers(0, 12, 900)] + draw.normal(size=(900, 24)) * np.geomspace(0.6, 0.01, 24),
        np.eye(24)[draw.integers(0, 24, 60)] * 9 + np.eye(24)[draw.integers(0, 24, 60)] * 3,
    ]).astype(np.float32)
    stored = np.unique(stored, axis=0)
    space = vectors.Space(stored, 8, 0.9, np.float32)
    squares = (stored.astype(float) ** 2).sum(axis=1)
    expected = np.triu(stored.astype(float) @ stored.T.astype(float) / np.sqrt(np.outer(squares, squares)) >= 0.9, 1)
    ids = np.arange(len(stored)).tobytes()
    for space.leading in (1, 4, 8, 24):
        block, again = (space.block(n, ids, None, None, stored.tobytes()) for n in (1, 2))
        for other, wanted in ((block, expected), (again, expected | expected.T | np.eye(len(stored), dtype=bool))):
            met = np.zeros(expected.shape, int)
            for x, y in vectors.linked_pairs(block, other, 0.9):
                np.add.at(met, (x, y), 1)
            assert (met == wanted).all()


def test_counts_as_bytes():
    for counts in ([0, 5, 0, 0, 0, 0, 0], [1, 2, 3, 0], [0] * 9 + [1 << 40], [1 << 33]):
        total = np.ones(len(counts), np.int64)
        vectors.add_counts(total, *vectors.packed_counts(np.array(counts)))
        assert total.tolist() == [1 + c for c in counts]


def test_equal_vectors_share_a_leaf_in_any_batch():
    """Limits of the tree are values of sampled vectors, so the last bit of a sum must not decide."""
    draw = np.random.default_rng(8)
    stored = draw.normal(size=(1501, 37)).astype(np.float32) * np.float32(10.0) ** draw.integers(-30, 30, (1501, 1))
    space = vectors.Space(stored, 400, 0.9, np.float32)
    leaves = space.leaves_of(stored)
    assert len(set(leaves)) > 100
    for size in (1, 2, 3, 5, 8, 13, 700):
        parts = [space.leaves_of(stored[at:at + size].copy()) for at in range(0, len(stored), size)]
        assert (np.concatenate(parts) == leaves).all()
    whole = space.whole_numbers(stored)
    assert (whole == np.rint(whole)).all() and np.abs(whole).max() < 2.0**53
