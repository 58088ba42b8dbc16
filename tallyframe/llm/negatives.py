"""Hard negatives by cover trees over norm-augmented candidates.

Every candidate gets one more component that makes all norms equal, so that the
candidates with the largest inner products are the nearest ones, and balls in
the augmented space bound inner products: a node with centre c and covering
radius r holds scores within q·c ± |q| r only.

A cover tree over a bounded sample deals all rows to cells, which are cut into
blocks of bounded size (a crowded cell into several).  Every block holds its own
cover tree: centres at halving distances, each node with the radius that covers
what lies below it.  A search descends it best first by the upper bound, leaves
out nodes outside its windows of scores, and verifies leaves by exact whole
numbers.  Sample and trees change no result, only how much is left out.

1. Anchors search their own cell for positives; the score of the last one found
   rules out other cells, and the remaining ones are searched.
2. Each positive gives a window of scores.  Anchors visit the cells that can hold
   scores in their windows and bring the best few of each block; a window of
   rows per positive, cut in every task before the shuffle, keeps the best.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.llm.clusters import EXACT_IN_DOUBLES, SCALE, whole
from tallyframe.sources.staging import staged

CELLS, CELL_ROWS = 4096, 1024  # a cell per 1,024 rows, as many as a broadcast of centres may hold
SAMPLE_PER_CELL = 16
BLOCK = 4096
ANCHORS = 2048
LEAF, BRANCH = 256, 32
SLACK = 1e-9


def cover_tree(points: np.ndarray, leaf: int) -> list[tuple[int, float, list[int], np.ndarray]]:
    """Nodes (centre, radius, children, rows): centres are rows, children lie at half the distance.

    Centres are taken farthest first until they cover a node's points within half
    its radius, or as far as ``BRANCH`` children and leaves of the wanted size
    allow; so they lie at least the children's covering distance apart.  Few
    points, or only copies, are a leaf.
    """
    nodes: list = [None]
    first = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    todo = [(0, 0, np.arange(len(points)), first)]
    while todo:
        at, centre, rows, away = todo.pop()
        radius = float(away.max())
        if len(rows) <= leaf or radius == 0:
            nodes[at] = (centre, radius, [], rows)
            continue
        # Greedy cover at half the radius: each centre takes what is near and not nearer to one before.
        parts, owner, nearest = [], np.zeros(len(rows), np.int64), away.copy()
        centres = [centre]
        while len(centres) < min(BRANCH, len(rows) // leaf + 1):
            far = int(nearest.argmax())
            if nearest[far] <= radius / 2:
                break
            centres.append(int(rows[far]))
            distance = np.sqrt(((points[rows] - points[rows[far]]) ** 2).sum(axis=1))
            nearer = distance < nearest
            owner[nearer], nearest[nearer] = len(centres) - 1, distance[nearer]
        children = []
        for number, chosen in enumerate(centres):
            here = owner == number
            if here.any():
                children.append(len(nodes))
                nodes.append(None)
                parts.append((children[-1], chosen, rows[here], nearest[here]))
        todo += parts
        nodes[at] = (centre, radius, children, rows[:0])
    return nodes


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more component, so that all have the squared norm ``most``."""
    x = x.astype(np.float64)
    rest = np.maximum(0, most - np.einsum("ij,ij->i", x, x))
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors with one of them."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0))
    if most * max(1, x.shape[1]) < EXACT_IN_DOUBLES:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


class Block:
    """Candidates with a cover tree, laid out so that a leaf is a run of rows."""

    def __init__(self, keys, ids, labels, x: np.ndarray, most: float):
        tree = cover_tree(augmented(x, most), LEAF)
        order = np.concatenate([rows for _, _, children, rows in tree if not children])
        self.keys, self.ids, self.labels, self.x = keys[order], ids[order], labels[order], x[order]
        self.double = self.x.astype(np.float64)
        self.centres = x[[centre for centre, _, _, _ in tree]].astype(np.float64)
        self.radii = np.array([radius for _, radius, _, _ in tree]) * (1 + SLACK)
        self.children = [np.array(c, np.int64) for _, _, c, _ in tree]
        self.run: list = [None] * len(tree)
        at = 0
        for number, (_, _, children, rows) in enumerate(tree):
            if not children:
                self.run[number] = slice(at, at + len(rows))
                at += len(rows)
        self.small = int(np.abs(x).max(initial=0))

    def descend(self, q: np.ndarray, wanted: Callable[[float, float], bool], leaf: Callable) -> None:
        """Best first by upper bound; a node is opened if its scores' bounds are still ``wanted``.

        ``leaf`` takes a run of rows with its exact scores.
        """
        double = q.astype(np.float64)
        norm = float(np.sqrt(double @ double))
        exact = max(1, len(q)) * self.small * int(np.abs(q).max(initial=0)) < EXACT_IN_DOUBLES

        def push(nodes: np.ndarray) -> None:
            middle = self.centres[nodes] @ double
            reach = norm * self.radii[nodes] + SLACK * (1 + np.abs(middle))
            for node, high, low in zip(nodes.tolist(), (middle + reach).tolist(), (middle - reach).tolist()):
                heappush(heap, (-high, low, node))

        heap: list[tuple[float, float, int]] = []
        push(np.zeros(1, np.int64))
        while heap:
            high, low, node = heappop(heap)
            if not wanted(low, -high):
                continue
            if self.run[node] is None:
                push(self.children[node])
            else:
                run = self.run[node]
                scores = (self.double[run] @ double).astype(np.int64) if exact else self.x[run] @ q
                leaf(run, scores)


def best(rows: list[tuple], count: int) -> list[tuple]:
    """The first (score, id, key) rows: higher scores, then smaller ids."""
    return sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:count]


def positives_of(block: Block, key: int, label: int, q: np.ndarray, count: int, least: float) -> list[tuple]:
    """The best rows of an anchor's label other than itself, none below ``least``."""
    found: list[tuple] = []

    def floor() -> float:
        return max(least, found[-1][0]) if len(found) == count else least

    def leaf(run: slice, scores: np.ndarray) -> None:
        nonlocal found
        near = np.flatnonzero(
            (block.labels[run] == label) & (block.keys[run] != key) & (scores >= floor())
        )
        if len(near):
            found = best(found + list(zip(
                scores[near].tolist(), block.ids[run][near].tolist(), block.keys[run][near].tolist()
            )), count)

    block.descend(q, lambda low, high: high >= floor(), leaf)
    return found


def negatives_of(
    block: Block, label: int, q: np.ndarray, windows: list[tuple[int, int]], count: int
) -> list[list[tuple]]:
    """Per window of scores, both ends included: its best rows of another label."""
    found: list[list[tuple]] = [[] for _ in windows]

    def open_at(low: float, high: float) -> list[int]:
        return [
            i for i, (least, most) in enumerate(windows)
            if high >= least and low <= most and (len(found[i]) < count or high >= found[i][-1][0])
        ]

    def leaf(run: slice, scores: np.ndarray) -> None:
        other = block.labels[run] != label
        for i in open_at(float(scores.min()), float(scores.max())):
            least, most = windows[i]
            near = np.flatnonzero(other & (scores >= least) & (scores <= most))
            if len(near) > count:  # the last score among the best is kept with all its ties
                last = np.partition(scores[near], len(near) - count)[len(near) - count]
                near = near[scores[near] >= last]
            if len(near):
                found[i] = best(found[i] + list(zip(
                    scores[near].tolist(), block.ids[run][near].tolist(), block.keys[run][near].tolist()
                )), count)

    block.descend(q, lambda low, high: bool(open_at(low, high)), leaf)
    return found


def _numbers(column, width: int, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


class Candidates:
    """All rows as whole vectors, dealt to cells, and their blocks."""

    def __init__(self, rows: DataFrame, width: int, scale: int, cells: int, block: int):
        """``rows``: key, id, label, anchor, embedding (doubles without null or non-finite ones)."""
        def prepare(batches):
            for part in batches:
                x = np.zeros((len(part), width), np.int64)
                for i, values in enumerate(part["embedding"]):
                    x[i, :len(values)] = whole(np.asarray(values, np.float64), scale)
                yield pd.DataFrame({
                    "key": part["key"], "id": part["id"], "label": part["label"],
                    "anchor": part["anchor"],
                    "x": [v.tobytes() for v in x],
                    "norm": np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)),
                })

        self.width, self.block = width, block
        vectors = staged(rows.mapInPandas(
            prepare, "key long, id long, label long, anchor boolean, x binary, norm double"),
            "whole-vectors")
        most, count = vectors.agg(F.max("norm"), F.count(F.lit(1))).first()
        self.most = most * (1 + SLACK)
        cells = max(1, min(cells, count // CELL_ROWS))
        sample = vectors.orderBy(F.xxhash64("key")).limit(SAMPLE_PER_CELL * cells).select("x").toPandas()
        points = np.unique(_numbers(sample["x"], width), axis=0)
        tree = cover_tree(augmented(points, self.most), max(1, len(points) // cells))
        chosen = sorted({centre for centre, _, children, _ in tree if not children})[:cells]
        self.centres = points[chosen]
        self.spark = rows.sparkSession
        held = self.spark.sparkContext.broadcast((self.centres, self.most))

        def deal(batches):
            centres, most = held.value
            centres = augmented(centres, most)
            for part in batches:
                if len(part):
                    near = augmented(_numbers(part["x"], width), most) @ centres.T
                    away = np.sqrt(np.maximum(0, 2 * (most - near.max(axis=1))))
                    yield part.drop(columns="norm").assign(cell=near.argmax(axis=1), away=away)

        self.vectors = staged(vectors.mapInPandas(
            deal, "key long, id long, label long, anchor boolean, x binary, cell long, away double"),
            "cells")
        # One row per cell, ``cells`` at most.
        sizes = self.vectors.groupBy("cell").agg(
            F.ceil(F.count(F.lit(1)) / block).alias("parts"), F.max("away").alias("radius"))
        self.sizes = staged(sizes, "cell-sizes")
        self.radii = np.full(len(chosen), -1.0)
        for row in self.sizes.collect():
            # Distances by inner products of equal norms: a little slack for their rounding.
            self.radii[row["cell"]] = row["radius"] * (1 + 1e-6) + 1e-6 * np.sqrt(self.most) + 1e-6
        names = ["key", "id", "label", "x", "cell"]
        self.blocks = staged(
            self.vectors.select(names).join(F.broadcast(self.sizes.select("cell", "parts")), "cell")
            .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).drop("parts")
            .groupBy("cell", "part").applyInPandas(
                _pack, "cell long, part long, n long, keys binary, ids binary, labels binary, x binary"),
            "blocks",
        )

    def visits(self, anchors: DataFrame, chosen: Callable, extra: str) -> DataFrame:
        """Anchors with each cell that ``chosen(q, centres, radii, row)`` says they have to visit."""
        held = self.spark.sparkContext.broadcast((self.centres.astype(np.float64), self.radii))
        width, names = self.width, anchors.columns

        def visit(batches):
            centres, radii = held.value
            for part in batches:
                for at in range(0, len(part), 256):
                    some = part.iloc[at:at + 256]
                    q = _numbers(some["x"], width).astype(np.float64)
                    middle = q @ centres.T
                    reach = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * radii + SLACK * (1 + np.abs(middle))
                    open_cells = chosen(some, middle - reach, middle + reach) & (radii >= 0)
                    yield some.assign(visit=[np.flatnonzero(o) for o in open_cells])

        schema = f"{extra}, visit array<long>"
        return anchors.mapInPandas(visit, schema).select(*names, F.explode("visit").alias("visit"))

    def search(self, visits: DataFrame, find: Callable, result: str, anchors: int = ANCHORS) -> DataFrame:
        """``find(block, anchor rows)`` for every cell's blocks and the anchors that visit it.

        The anchors of a cell are dealt to groups of bounded size, and each group
        meets each block of the cell in a task of its own.
        """
        visits = staged(visits, "visits")
        groups = visits.groupBy("visit").agg(F.ceil(F.count(F.lit(1)) / anchors).alias("groups"))
        groups = staged(groups, "visit-groups")  # one row per cell
        named = (
            visits.join(F.broadcast(groups), "visit")
            .withColumn("group", F.pmod(F.xxhash64("key"), F.col("groups"))).drop("groups")
            .join(F.broadcast(self.sizes.select(F.col("cell").alias("visit"), "parts")), "visit")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        )
        dealt = self.blocks.join(
            F.broadcast(groups.withColumnRenamed("visit", "cell")), "cell"
        ).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
        width, most = self.width, self.most

        def meet(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            row = block.iloc[0] if len(block) and len(some) else None
            made = None if row is None else Block(
                *(np.frombuffer(row[c], np.int64) for c in ("keys", "ids", "labels")),
                np.frombuffer(row["x"], np.int64).reshape(int(row["n"]), width), most,
            )
            return find(made, some)

        return dealt.groupBy("cell", "part", "group").cogroup(
            named.groupBy("visit", "part", "group")).applyInPandas(meet, result)


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({
        "cell": [key[0]], "part": [key[1]], "n": [len(rows)],
        "keys": [rows["key"].to_numpy(np.int64).tobytes()], "ids": [rows["id"].to_numpy(np.int64).tobytes()],
        "labels": [rows["label"].to_numpy(np.int64).tobytes()], "x": [b"".join(rows["x"])],
    })


def _first(rows: DataFrame, by: list[str], score: str, tie: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of each group with their rank, which tasks cut before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


ANCHOR = "key long, id long, label long, x binary"
POSITIVE = "anchor long, positive_key long, positive_id long, positive_score long"
NEGATIVE = (
    "anchor long, anchor_id long, positive_key long, positive_id long, positive_score long, "
    "negative_key long, negative_id long, negative_score long"
)


def hard_negatives(
    table: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, key: str = "vec_id", column: str = "embedding",
    scale: int = SCALE, cells: int = CELLS, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` and ``anchors`` are expressions on ``table``.  An anchor's positives
    are its best rows of the same label; a positive's negatives are the best rows
    of other labels with ``low`` % to ``high`` % of its score.  A row takes part if
    id, label and vector are not null and no component is null or non-finite.  A
    shorter vector counts as filled up with zeros, an empty one as all zeros.
    Rows that repeat an id are rows of their own: each is an anchor, and one can
    be a positive of another.  Ties of score and id fall to either row.
    Components whose products 64 bits do not hold (beyond 2**27 when scaled) raise.
    """
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    named = table.select(
        F.monotonically_increasing_id().alias("key"), F.col(key).cast("long").alias("id"),
        label.cast("long").alias("label"), F.col(column).cast("array<double>").alias("embedding"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.coalesce(finite, F.lit(False)).alias("finite"),
    ).where("finite and id is not null and label is not null")
    rows = named.drop("finite")
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    result = (
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
        "negative_score long"
    )
    if width is None:
        return table.sparkSession.createDataFrame([], result)
    made = Candidates(rows, max(1, width), scale, cells, block)
    start = made.vectors.where("anchor").select("key", "id", "label", "x", "cell")
    width = made.width

    def nearest(made_block: Block | None, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in some.itertuples() if made_block else ():
            q = np.frombuffer(row.x, np.int64)
            least = getattr(row, "least", None)
            least = -np.inf if least is None or np.isnan(least) else least
            for score, number, at in positives_of(made_block, row.key, row.label, q, positives, least):
                out.append((row.key, at, number, score))
        return pd.DataFrame(out, columns=["anchor", "positive_key", "positive_id", "positive_score"], dtype=np.int64)

    own = made.search(start.withColumnRenamed("cell", "visit"), nearest, POSITIVE)
    own = staged(_first(own, ["anchor"], "positive_score", ["positive_id", "positive_key"], positives), "own-cell")
    limits = own.where(F.col("rank") == positives).select(
        F.col("anchor").alias("key"), F.col("positive_score").cast("double").alias("least"))
    limited = start.join(limits, "key", "left")

    def reaches(some: pd.DataFrame, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        wanted = some["least"].fillna(-np.inf).to_numpy(np.float64)
        other = np.arange(most.shape[1]) != some["cell"].to_numpy(np.int64)[:, None]
        return other & (most >= wanted[:, None])

    others = made.search(
        made.visits(limited, reaches, f"{ANCHOR}, cell long, least double"), nearest, POSITIVE)
    found = staged(_first(
        own.drop("rank").unionByName(others), ["anchor"], "positive_score",
        ["positive_id", "positive_key"], positives,
    ).drop("rank"), "positives")

    # At most ``positives`` entries per anchor.
    windowed = start.drop("cell").join(
        found.groupBy(F.col("anchor").alias("key")).agg(F.sort_array(F.collect_list(F.struct(
            "positive_score", "positive_key", "positive_id"))).alias("p")), "key",
    ).select(
        "key", "id", "label", "x", F.col("p.positive_score").alias("scores"),
        F.col("p.positive_key").alias("keys"), F.col("p.positive_id").alias("ids"),
    )

    def windows_of(scores) -> list[tuple[int, int]]:
        return [(-(-low * int(s) // 100), high * int(s) // 100) for s in scores]

    def overlaps(some: pd.DataFrame, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(least.shape, bool)
        for i, scores in enumerate(some["scores"]):
            for bottom, top in windows_of(scores):
                if bottom <= top:
                    out[i] |= (most[i] >= bottom) & (least[i] <= top)
        return out

    def hard(made_block: Block | None, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in some.itertuples() if made_block else ():
            per_window = negatives_of(
                made_block, row.label, np.frombuffer(row.x, np.int64), windows_of(row.scores), negatives)
            for score, at, number, hits in zip(row.scores, row.keys, row.ids, per_window):
                out += [(row.key, row.id, at, number, score, k, n, s) for s, n, k in hits]
        names = [c.split()[0] for c in NEGATIVE.split(", ")]
        return pd.DataFrame(out, columns=names, dtype=np.int64)

    extra = f"{ANCHOR}, scores array<long>, keys array<long>, ids array<long>"
    hits = made.search(made.visits(windowed, overlaps, extra), hard, NEGATIVE)
    return _first(
        hits, ["anchor", "positive_key"], "negative_score", ["negative_id", "negative_key"], negatives
    ).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )
