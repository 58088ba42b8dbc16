"""Near-duplicate vectors by cosine, compared block by block in PCA order.

Unit vectors are rotated onto principal axes, so their leading dimensions hold
most of their length.  A tree over the leading axes, built on a bounded sample,
gives all vectors an order, which is cut into blocks of bounded size.  Two blocks
whose boxes lie further apart than the threshold allows are never compared.  Of
two blocks the leading dimensions are multiplied first, with the norm of what is
left as one more dimension: that product is never less than the whole one, and
only pairs it leaves open are multiplied whole.  Both are products of single
precision; a pair within their rounding of the threshold is decided by its stored
components.  Any rotation, tree and number of leading dimensions give the same
links; they only decide how early a pair is given up.

Vectors move once, to their block.  The pairs of blocks are a Cartesian product
of the written blocks, so each task reads some blocks for one side and some for
the other and nothing is shuffled for a pair.  Equal vectors are merged before
and counted.  A block joins its own vectors when it is packed, and a task returns
a count per vector and a spanning forest of the parts of its blocks, so a group of
copies never becomes a list of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallyframe.llm.graph import components
from tallyframe.sources.staging import staged

SAMPLE = 4096
TILE = 8192
TILE_BYTES = 1 << 20  # of the vectors of a block
LEAST_TILE = 64
STRIPE_BYTES = 32 << 20  # of the blocks that a task holds while others pass by
SEGMENTS = 16
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  # of pairs of blocks that are sent to Python at once
LEAVES = 512
ROWS_AT_ONCE, COLUMNS_AT_ONCE = 256, 1024
VALUES_AT_ONCE = 1 << 21
CROWDED = 0.02  # of a strip; then all of it is multiplied whole
DIGEST_BYTES = 16
SLACK = 1e-9  # boxes give way to rounding
MERGED = "leaf int, digest binary, first long, copies long, vector binary"
BLOCK = (
    "block long, ids binary, digests binary, copies binary, parts binary, vectors binary, "
    "at binary, n binary, low array<double>, high array<double>"
)
FOUND = "block long, at binary, n binary, a long, b long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe for very large and very small components."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix, columns by falling second moment of the unit vectors."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(axes[:, ::-1])


class Tree:
    """Splits at medians of the axis of largest spread; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int] | int] = [0]
        todo = [(0, sample)]
        open_leaves = 1
        while todo:
            at, here = todo.pop(0)
            spread = here.max(axis=0) - here.min(axis=0) if len(here) else np.zeros(1)
            axis = int(spread.argmax())
            if open_leaves >= leaves or len(here) < 8 or spread[axis] <= 0:
                continue
            middle = float(np.median(here[:, axis]))
            below = here[:, axis] < middle
            if not below.any():
                middle = float(here[:, axis][here[:, axis] > middle].min())
                below = here[:, axis] < middle
            self.nodes[at] = (axis, middle, len(self.nodes), len(self.nodes) + 1)
            todo += [(len(self.nodes), here[below]), (len(self.nodes) + 1, here[~below])]
            self.nodes += [0, 0]
            open_leaves += 1
        to_number, leaf = [0], 0
        while to_number:
            at = to_number.pop()
            if isinstance(self.nodes[at], int):
                self.nodes[at] = leaf
                leaf += 1
            else:
                to_number += [self.nodes[at][3], self.nodes[at][2]]

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            at, here = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[here] = node
                continue
            axis, middle, low, high = node
            below = vectors[here, axis] < middle
            todo += [(low, here[below]), (high, here[~below])]
        return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exactly, so that their squares neither overflow nor vanish."""
    _, exponents = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponents[:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of stored vectors, row by row."""
    a, b = scaled(a.astype(np.float64)), scaled(b.astype(np.float64))
    squares = np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(squares)


def with_rest(units: np.ndarray, leading: int) -> np.ndarray:
    """The leading dimensions and the norm of the others, whose products are bounds of the whole ones."""
    rest = np.sqrt(np.einsum("ij,ij->i", units[:, leading:], units[:, leading:]))
    return np.concatenate([units[:, :leading], rest[:, None]], axis=1)


def leading_dimensions(units: np.ndarray, least: float) -> int:
    """How many dimensions to multiply first, by what that leaves open on a sample."""
    width, strip = units.shape[1], ROWS_AT_ONCE * COLUMNS_AT_ONCE
    single = units.astype(np.float32)

    def cost(leading: int) -> float:  # in dimensions of all pairs: searched strips and gathered pairs on top
        head = with_rest(single, leading)
        share = sum(
            np.count_nonzero((head[at:at + ROWS_AT_ONCE] @ head.T >= least) & far)
            for at, far in zip(range(0, len(head), ROWS_AT_ONCE), apart)
        ) / len(head) ** 2
        return leading + 30 * (1 - (1 - share) ** strip) + 40 * width * share

    apart = [single[at:at + ROWS_AT_ONCE] @ single.T < least for at in range(0, len(single), ROWS_AT_ONCE)]
    return min([*range(4, width, 4), width], key=cost)


@dataclass
class Block:
    """Distinct vectors: as stored, rotated, and their leading dimensions with the rest."""

    number: int
    ids: np.ndarray
    copies: np.ndarray
    stored: np.ndarray
    whole: np.ndarray
    head: np.ndarray
    parts: np.ndarray  # per part of linked vectors its smallest id
    part_of: np.ndarray


def linked_pairs(a: Block, b: Block, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with a cosine of at least ``least``; of a block with itself, only i < j."""
    width = a.whole.shape[1]
    slack = (width + 16) * 2.0**-23  # twice the rounding of products of single precision, or more
    at_once = max(1, VALUES_AT_ONCE // width)
    for at in range(0, len(a.head), ROWS_AT_ONCE):
        top, whole_top = a.head[at:at + ROWS_AT_ONCE], a.whole[at:at + ROWS_AT_ONCE]
        for to in range(at // COLUMNS_AT_ONCE * COLUMNS_AT_ONCE if a is b else 0, len(b.head), COLUMNS_AT_ONCE):
            bounds = top @ b.head[to:to + COLUMNS_AT_ONCE].T
            if bounds.max() < least - slack:
                continue
            still_open = np.flatnonzero(bounds >= least - slack)
            i, j = np.divmod(still_open, bounds.shape[1])
            products = None
            if len(i) > CROWDED * bounds.size:
                products = (whole_top @ b.whole[to:to + COLUMNS_AT_ONCE].T).ravel()[still_open]
            i, j = i + at, j + to
            if a is b:
                upper = i < j
                i, j, products = i[upper], j[upper], None if products is None else products[upper]
            for start in range(0, len(i), at_once):
                x, y = i[start:start + at_once], j[start:start + at_once]
                p = (np.einsum("ij,ij->i", a.whole[x], b.whole[y]) if products is None
                     else products[start:start + at_once])
                near = p >= least + slack
                tied = np.flatnonzero(np.abs(p - least) <= slack)
                near[tied] = cosines(a.stored[x[tied]], b.stored[y[tied]]) >= least
                yield x[near], y[near]


class Forest:
    """Groups of indices; joining returns the pairs of former roots that it joined."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        x, y = self.root[x], self.root[y]
        apart = x != y
        if not apart.any():
            return []
        codes = np.unique(x[apart] * len(self.root) + y[apart])
        to: dict[int, int] = {}
        joined = []
        for one, other in zip((codes // len(self.root)).tolist(), (codes % len(self.root)).tolist()):
            one, other = find(to, one), find(to, other)
            if one != other:
                to[max(one, other)] = min(one, other)
                joined.append((one, other))
        moved = np.arange(len(self.root))
        for one in list(to):
            moved[one] = find(to, one)
        self.root = moved[self.root]
        return joined


def find(to: dict[int, int], one: int) -> int:
    """The root of ``one``; the way to it is shortened."""
    root = one
    while to.get(root, root) != root:
        root = to[root]
    while to.get(one, one) != root:
        to[one], one = root, to[one]
    return root


def packed_counts(counts: np.ndarray) -> tuple[bytes | None, bytes]:
    """Places and counts as bytes; no places if most are counted."""
    kind = np.int32 if counts.max() < 1 << 31 else np.int64
    at = np.flatnonzero(counts)
    if 3 * len(at) > len(counts):
        return None, counts.astype(kind).tobytes()
    return at.astype(np.int32).tobytes(), counts[at].astype(kind).tobytes()


def add_counts(total: np.ndarray, at: bytes | None, n: bytes) -> None:
    places = slice(None) if at is None else np.frombuffer(at, np.int32)
    size = len(total) if at is None else len(places)
    total[places] += np.frombuffer(n, np.int32 if len(n) == 4 * size else np.int64)


class Space:
    """What tasks know of the vectors of one length: the rotation, its tree, how to prepare blocks."""

    def __init__(self, sample: np.ndarray, leaves: int, least: float, kind: type):
        self.axes, self.least, self.kind = principal_axes(unit(sample.astype(np.float64))), least, kind
        self.width = sample.shape[1]
        # Squares and products of so many bits are summed without rounding.
        self.grid = 2.0 ** min(20, (52 - self.width.bit_length()) // 2)
        self.tree = Tree(self.whole_numbers(sample), leaves)
        self.leading = leading_dimensions(self.rotated(sample), least)

    def rotated(self, stored: np.ndarray) -> np.ndarray:
        return unit(stored.astype(np.float64)) @ self.axes

    def whole_numbers(self, stored: np.ndarray) -> np.ndarray:
        """Rotated vectors on a grid, the same for equal vectors in whatever batch and on whatever processor."""
        vectors = stored.astype(np.float64)
        vectors = np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * self.grid)
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        return np.rint(vectors / lengths[:, None] * self.grid) @ np.rint(self.axes * self.grid)

    def leaves_of(self, stored: np.ndarray) -> np.ndarray:
        return self.tree.leaves_of(self.whole_numbers(stored))

    def block(self, number: int, ids: bytes, copies: bytes | None, parts: bytes | None, vectors: bytes) -> Block:
        ids = np.frombuffer(ids, np.int64)
        stored = np.frombuffer(vectors, self.kind).reshape(len(ids), -1)
        units = self.rotated(stored)
        parts, part_of = np.unique(
            ids if parts is None else np.frombuffer(parts, np.int64), return_inverse=True
        )
        return Block(
            number, ids, np.ones(len(ids), np.int64) if copies is None else np.frombuffer(copies, np.int64),
            stored, units.astype(np.float32), with_rest(units, self.leading).astype(np.float32), parts, part_of,
        )


def able(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors, by length, of the rows (id, embedding) that can link."""
    lists = batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    with_id = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero((sizes == width) & with_id)
        vectors = (
            values.reshape(-1, width)[at] if (sizes == width).all()
            else values[starts[at][:, None] + np.arange(width)]
        )
        good = np.isfinite(vectors).all(axis=1) & vectors.any(axis=1)
        yield at[good], np.ascontiguousarray(vectors[good], kind) + kind(0)  # zeros lose their sign


def digests_of(vectors: np.ndarray) -> list[bytes]:
    content, size = memoryview(vectors.tobytes()), vectors.itemsize * vectors.shape[1]
    return [
        hashlib.blake2b(content[at:at + size], digest_size=DIGEST_BYTES).digest()
        for at in range(0, len(content), size)
    ]


def marked(kind: type) -> Callable:
    """(id, width, digest) per row, without width and digest where it cannot link."""

    def mark(batches):
        for batch in batches:
            widths, digests = [None] * batch.num_rows, [None] * batch.num_rows
            for at, vectors in able(batch, kind):
                for place, digest in zip(at.tolist(), digests_of(vectors)):
                    widths[place], digests[place] = vectors.shape[1], digest
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(widths, pa.int32()), pa.array(digests, pa.binary())],
                names=["id", "width", "digest"],
            )

    return mark


def table_of(leaf, digests: list[bytes], first, copies, vectors: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(leaf, pa.int32()), pa.array(digests, pa.binary()), pa.array(first, pa.int64()),
         pa.array(copies, pa.int64()), pa.array(vectors, pa.binary())],
        names=["leaf", "digest", "first", "copies", "vector"],
    )


def turned(held, kind: type) -> Callable:
    """Distinct vectors of each batch with their leaf, smallest id and number of copies."""

    def turn(batches):
        space = held.value
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            for at, vectors in able(batch, kind):
                if vectors.shape[1] != space.width or not len(at):
                    continue
                number: dict[bytes, int] = {}
                which = np.array([number.setdefault(d, len(number)) for d in digests_of(vectors)])
                first = np.full(len(number), np.iinfo(np.int64).max)
                np.minimum.at(first, which, ids[at])
                vectors = vectors[np.unique(which, return_index=True)[1]]
                yield table_of(
                    space.leaves_of(vectors), list(number), first,
                    np.bincount(which), [v.tobytes() for v in vectors],
                )

    return turn


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by leaf and digest, those of one digest as one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        digests = rows.column(1).to_pylist()
        starts = np.flatnonzero([True, *(a != b for a, b in zip(digests, digests[1:]))])
        kept = rows.take(pa.array(starts))
        out = pa.RecordBatch.from_arrays(
            [kept.column(0), kept.column(1),
             pa.array(np.minimum.reduceat(rows.column(2).to_numpy(), starts)),
             pa.array(np.add.reduceat(rows.column(3).to_numpy(), starts)), kept.column(4)],
            names=rows.schema.names,
        )
        yield out.slice(0, out.num_rows - 1)
        held = out.slice(out.num_rows - 1)
    if held is not None:
        yield held


def packed(held, tile: int) -> Callable:
    """Blocks of at most one and a half tiles, with the links that lie within each."""

    def blocks_of(batches):
        rows = None
        for batch in merged(batches):
            rows = batch if rows is None else pa.concat_batches([rows, batch])
            while rows.num_rows >= tile + tile // 2 + 1:
                yield rows.slice(0, tile)
                rows = rows.slice(tile)
        if rows is not None and rows.num_rows:
            yield rows

    def pack(batches):
        space, task = held.value, TaskContext.get().partitionId()
        for number, rows in enumerate(blocks_of(batches)):
            ids, copies = rows.column(2).to_numpy(), rows.column(3).to_numpy()
            copies = None if (copies == 1).all() else copies.tobytes()
            vectors = b"".join(rows.column(4).to_pylist())
            block = space.block((task << 32) + number, ids.tobytes(), copies, None, vectors)
            n, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
            for x, y in linked_pairs(block, block, space.least):
                if len(x):
                    n += np.bincount(x, block.copies[y], len(n)).astype(np.int64)
                    n += np.bincount(y, block.copies[x], len(n)).astype(np.int64)
                    forest.join(x, y)
            least = ids.copy()
            np.minimum.at(least, forest.root, ids)
            at, n = packed_counts(n) if n.any() else (None, None)
            units = space.rotated(block.stored)
            yield pa.RecordBatch.from_pylist([{
                "block": block.number, "ids": ids.tobytes(), "digests": b"".join(rows.column(1).to_pylist()),
                "copies": copies, "parts": None if n is None else least[forest.root].tobytes(),
                "vectors": vectors, "at": at, "n": n,
                "low": units.min(axis=0).tolist(), "high": units.max(axis=0).tolist(),
            }], schema=pa.schema([
                ("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "digests", "copies", "parts", "vectors", "at", "n")),
                ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
            ]))

    return pack


def found_rows(block: list, at: list, n: list, a: list, b: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip((block, at, n, a, b), kinds)], names=["block", "at", "n", "a", "b"]
    )


def compared(held) -> Callable:
    """Counts by block and links between parts, each part joined once in a task.

    Rows are pairs of blocks: one block of the left side meets those of the right
    side in turn, then the next one does.
    """

    def compare(batches):
        space = held.value
        right: dict[int, Block] = {}
        counts: dict[int, np.ndarray] = {}
        to: dict[int, int] = {}
        left = None

        def told(number: int) -> Iterator[pa.RecordBatch]:
            if number in counts:
                at, n = packed_counts(counts.pop(number))
                yield found_rows([number], [at], [n], [None], [None])

        for batch in batches:
            for row in range(batch.num_rows):
                one, other = (
                    [batch.column(f"{side}_{c}")[row] for c in ("block", "ids", "copies", "parts", "vectors")]
                    for side in "ab"
                )
                if left is None or left.number != one[0].as_py():
                    if left is not None and left.number not in right:
                        yield from told(left.number)
                    left = space.block(*content(one))
                number = other[0].as_py()
                if number not in right:
                    if len(right) * left.stored.nbytes > 2 * STRIPE_BYTES:
                        right.clear()
                    right[number] = space.block(*content(other))
                links = meet(left, right[number], space.least, counts, to)
                if links:
                    a, b = zip(*links)
                    yield found_rows([None] * len(a), [None] * len(a), [None] * len(a), a, b)
        for number in list(counts):
            yield from told(number)

    return compare


def content(row: list[pa.Scalar]) -> list:
    """Bytes of their own, since a batch is let go before its blocks are."""
    return [row[0].as_py(), *(s.as_py() for s in row[1:])]


def meet(
    a: Block, b: Block, least: float, counts: dict[int, np.ndarray], to: dict[int, int],
) -> list[tuple[int, int]]:
    """Count the links of two blocks; the links of parts that ``to`` did not join before."""
    forest, links = None, []
    for x, y in linked_pairs(a, b, least):
        if not len(x):
            continue
        for block, here, there in ((a, x, b.copies[y]), (b, y, a.copies[x])):
            if block.number not in counts:
                counts[block.number] = np.zeros(len(block.ids), np.int64)
            counts[block.number] += np.bincount(here, there, len(block.ids)).astype(np.int64)
        forest = forest or Forest(len(a.parts) + len(b.parts))
        links += forest.join(a.part_of[x], b.part_of[y] + len(a.parts))
    if not links:
        return []
    ids, new = np.concatenate([a.parts, b.parts]), []
    for one, other in ids[np.array(links)].tolist():
        one, other = find(to, one), find(to, other)
        if one != other:
            to[max(one, other)] = min(one, other)
            new.append((one, other))
    return new


def class_rows(key: tuple, block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The vectors of a block one by one, with all their links counted."""
    block = block.iloc[0]
    ids = np.frombuffer(block["ids"], np.int64)
    n = np.zeros(len(ids), np.int64)
    if block["n"] is not None:
        add_counts(n, block["at"], block["n"])
    for at, counts in zip(found["at"], found["n"]):
        add_counts(n, at, counts)
    return pd.DataFrame({
        "digest": [block["digests"][at:at + DIGEST_BYTES] for at in range(0, len(block["digests"]), DIGEST_BYTES)],
        "first": ids, "copies": 1 if block["copies"] is None else np.frombuffer(block["copies"], np.int64), "n": n,
        "part": ids if block["parts"] is None else np.frombuffer(block["parts"], np.int64),
    })


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """A few pairs of blocks a batch, since tasks hold a batch several times."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


def _sample(rows: DataFrame, valid: Column, width: int, count: int) -> np.ndarray:
    """Distinct vectors of one length, of few ids drawn by hash."""
    drawn = rows.where(F.col("id").isNotNull() & (F.size("embedding") == width))
    for every in (max(1, count // (2 * SAMPLE)), 1):
        some = (
            drawn.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).where(valid)
            .select("embedding").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
        )
        if some:
            break
    return np.unique(np.array([r.embedding for r in some], np.float64), axis=0)


def _blocks(rows: DataFrame, held, kind: type, count: int, distinct: int, tile: int) -> DataFrame:
    """The distinct vectors of one length, written in blocks that follow the tree."""
    cores = rows.sparkSession.sparkContext.defaultParallelism

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        return df.repartitionByRange(max(1, parts), "leaf", "digest").sortWithinPartitions("leaf", "digest")

    vectors = rows.mapInArrow(turned(held, kind), MERGED)
    if count > 2 * distinct:  # copies first, in tasks of bounded rows
        vectors = staged(dealt(vectors, -(-count // (8 * tile))).mapInArrow(merged, MERGED), "merged")
    parts = max(-(-distinct // tile), min(2 * cores, -(-distinct * 4 // tile)))
    return staged(dealt(vectors, parts).mapInArrow(packed(held, tile), BLOCK), "blocks")


def _met(blocks: DataFrame, held, block_bytes: int, least: float) -> DataFrame:
    """What pairs of blocks have in common, every pair once, in either order."""
    spark = blocks.sparkSession
    number, scans, tasks = blocks.count(), blocks.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism
    stripes = min(scans, max(-(-number * block_bytes // STRIPE_BYTES), int(np.sqrt(tasks))))
    segments = min(scans, max(min(SEGMENTS, number // 32), -(-tasks // stripes)))
    columns = ["block", "ids", "copies", "parts", "vectors", "low", "high"]
    left, right = (
        blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in columns]).coalesce(parts)
        for side, parts in (("a", segments), ("b", stripes))
    )
    gaps = F.zip_with(
        F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    furthest = 2 - 2 * least + SLACK  # the squared distance of unit vectors at the threshold
    # A hash tells which side the smaller number is on, so all tasks have as much to do.
    in_order = F.xxhash64(F.least("a_block", "b_block"), F.greatest("a_block", "b_block")).bitwiseAND(F.lit(1)) == 0
    return left.join(
        right.hint("shuffle_replicate_nl"),
        (F.col("a_block") != F.col("b_block")) & ((F.col("a_block") < F.col("b_block")) == in_order)
        & (F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap) <= furthest),
    ).select(
        *[f"{side}_{c}" for side in "ab" for c in ("block", "ids", "copies", "parts", "vectors")]
    ).mapInArrow(compared(held), FOUND)


def near_vectors(
    table: DataFrame, least: float = 0.9, key: str = "vec_id", column: str = "embedding",
    tile: int = TILE,
) -> DataFrame:
    """Per row: ``n_links``, ``component_id`` and ``kept`` by cosine of at least ``least``.

    A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing and is its own component, and so is a row without id.
    Vectors of different lengths are not compared.  Rows that repeat an id are
    one node: each counts as a vector, and where their vectors differ, links of
    the smallest id of a class add up.
    """
    spark = table.sparkSession
    single = table.schema[column].dataType == ArrayType(FloatType(), table.schema[column].dataType.containsNull)
    kind = np.float32 if single else np.float64
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    valid = finite & F.exists("embedding", lambda x: x != 0)
    rows = table.select(
        F.col(key).cast("long").alias("id"),
        F.col(column).cast(f"array<{'float' if single else 'double'}>").alias("embedding"),
    )
    marks = staged(rows.mapInArrow(marked(kind), "id long, width int, digest binary"), "digests")
    classes = links = None
    for row in marks.where("width is not null").groupBy("width").agg(
        F.count(F.lit(1)).alias("count"), F.approx_count_distinct("digest").alias("distinct")
    ).orderBy("width").collect():
        size = min(tile, max(LEAST_TILE, TILE_BYTES // (row.width * np.dtype(kind).itemsize)))
        sample = _sample(rows, valid, row.width, row["count"])
        leaves = min(LEAVES, -(-4 * row.distinct // size))
        held = spark.sparkContext.broadcast(Space(sample, leaves, least, kind))
        blocks = _blocks(rows, held, kind, row["count"], row.distinct, size)
        with _small_batches(spark):
            found = staged(_met(blocks, held, size * row.width * np.dtype(kind).itemsize, least), "vector-links")
        of = staged(
            blocks.select("block", "ids", "digests", "copies", "parts", "at", "n").groupBy("block")
            .cogroup(found.where("block is not null").select("block", "at", "n").groupBy("block"))
            .applyInPandas(class_rows, "digest binary, first long, copies long, n long, part long"), "classes",
        )
        met = found.where("block is null").select("a", "b")
        classes = of if classes is None else classes.unionByName(of)
        links = met if links is None else links.unionByName(met)
    if classes is None:
        return table.select(
            key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"),
            F.col(key).isNotNull().alias("kept"),
        )
    # Ids that stand for several vectors are one node.
    repeated = staged(
        classes.groupBy("first").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("vectors"))
        .where("vectors > 1").select("first", "all"), "repeated",
    )
    links = links.unionByName(
        classes.join(repeated, "first").select(F.col("first").alias("a"), F.col("part").alias("b"))
    )
    joined = components(links).withColumnRenamed("node", "part")
    per_class = (
        classes.join(repeated, "first", "left").join(joined, "part", "left")
        .select(
            "digest", (F.coalesce("all", "n") + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "part").alias("component_id"),
        )
    )
    per_row = marks.where("digest is not null").join(per_class, "digest").select("id", "n_links", "component_id")
    unable = marks.where("digest is null").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return per_row.unionByName(unable).select(
        F.col("id").alias(key), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
