"""Centroid clustering against plain rounds over all vectors."""

import hashlib

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tallyframe.llm import clusters
from tallyframe.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, block string"


def by_hash(vec_id):
    return F.sha2(F.concat(F.lit("2:"), vec_id.cast("string")), 256)


def plain(vectors, count, rounds):
    """{id: (cluster, distance)} and the centroids, every vector measured in every round."""
    ids = sorted(vectors, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    whole = {i: [int(np.floor(256 * float(v))) for v in x] for i, x in vectors.items()}
    centroids = [list(whole[i]) for i in ids[:count]]

    def assign():
        out = {}
        for i, x in whole.items():
            away = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out[i] = (away.index(min(away)), min(away))
        return out

    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            inside = [whole[i] for i in of if of[i][0] == c]
            if inside:
                centroids[c] = [sum(column) // len(inside) for column in zip(*inside)]
    return assign(), centroids


def check(spark, vectors, count, rounds, width, block):
    rows = [(i, [float(v) for v in x], "clash") for i, x in vectors.items()]
    made = clusters.cluster_vectors(
        spark.createDataFrame(rows, SCHEMA), count, rounds, by_hash, width, block=block
    )
    ours = {r["id"]: r for r in clusters.assignments(made).collect()}
    expected, centroids = plain(vectors, count, rounds)
    assert {i: (r["cluster"], r["distance"]) for i, r in ours.items()} == expected
    total = sum(d for _, d in expected.values())
    for i, (c, _) in expected.items():
        assert ours[i]["cluster_inertia"] == sum(d for other, d in expected.values() if other == c)
        assert ours[i]["inertia"] == total
        digest = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        assert ours[i]["centroid_sha256"] == digest
    return made


def test_matches_sql(spark, duck, data_dir):
    assert assert_same(QUERIES["op11_clusters"](spark, data_dir), duck, ORACLE_SQL["op11_clusters"])


def test_separated_groups_are_not_measured_again(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 20, (8, 5))
    vectors = {i: middles[i % 8] + rng.normal(0, 0.2, 5) for i in range(400)}
    made = check(spark, {i: np.float32(v) for i, v in vectors.items()}, 8, 5, 5, block=64)
    assert made.rescanned[0] == 400
    # The last rounds move nothing: their heaps have no expired entry.
    assert made.rescanned[-1] == 0 and sum(made.rescanned[1:]) < 800


def test_copies_ties_and_empty_clusters(spark):
    # A third of all rows is one vector; equal starting centroids leave clusters empty.
    vectors = {i: np.float32([1, -1]) if i % 3 == 0 else np.float32([i % 5 - 2, i % 7 - 3]) for i in range(90)}
    check(spark, vectors, 40, 5, 2, block=16)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    vectors = {i: np.float32(rng.normal(0, 1e5, 3)) for i in range(60)}
    check(spark, vectors, 6, 4, 3, block=16)
    with pytest.raises(ValueError, match="no exact distance"):
        clusters.whole(np.array([[1e9]]), 256)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (None, [3.0, 4.0], None), (2, None, "x"), (3, [], "x"),
        (4, [1.0], "x"), (5, [1.0, nan], "x"), (6, [inf, 1.0], "x"), (7, [1.0, None], "x"), (8, [0.0, 0.0], "x"),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    made = clusters.cluster_vectors(table, 40, 2, by_hash, 2)
    assert len(made.centroids) == 4  # fewer vectors than clusters: each starts one
    ours = clusters.assignments(made).collect()
    assert sorted(str(r["id"]) for r in ours) == ["1", "1", "8", "None"]
    assert {r["distance"] for r in ours} == {0}
    empty = clusters.cluster_vectors(table.where("false"), 40, 2, by_hash, 2)
    assert clusters.assignments(empty, spark).collect() == []


def test_vectors_do_not_move_between_rounds(spark, data_dir):
    from tallyframe.sources.files import load

    made = clusters.cluster_vectors(load(spark, data_dir, "embeddings"), 40, 1, by_hash, 64)
    joined = made.vectors.groupBy("block").cogroup(made.state.drop("delta").groupBy("block")).applyInPandas(
        lambda b, s: b[["block"]], "block long")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan  # of the narrow state only
