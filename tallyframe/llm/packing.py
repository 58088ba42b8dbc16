"""Hierarchical packing of token streams into windows of several lengths.

Texts are routed to tiers of context sizes.  Full windows of the longest tier
are cut first; what remains of a text goes to the smallest tier that holds it.
Each tier is packed from the longest down: a remainder opens a window, and its
gap is filled from shorter tiers, with whole texts while they fit and with a cut
one at the end.  When nothing is left to fill with, the last window is split
into windows whose lengths are powers of two.  So every window is full.

A task packs its texts in cells of bounded token counts and never needs another
task's, so nothing is shuffled.  Windows are grouped into steps of equal token
counts; only the last step of a cell may be smaller.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyframe.llm.common import slices
from tallyframe.llm.tokens import WordIds

TIERS = (4096, 2048, 1024, 512, 256)
CELL_TOKENS = 4 << 20
STEP_TOKENS = 1 << 16
COLUMNS = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, window bigint, step_group bigint"
)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (text, start, length); each is as long as a power of two."""
    longest, windows = tiers[0], []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def route(text: int, start: int, length: int) -> None:
        if length:
            pools[min(t for t in tiers if t >= length)].append((text, start, length))

    for text, length in enumerate(lengths):
        whole = length - length % longest
        windows += [[(text, at, longest)] for at in range(0, whole, longest)]
        route(text, whole, length - whole)
    # Popped from the end: of the shorter tiers, the longest texts fill first.
    for pool in pools.values():
        pool.sort(key=lambda piece: piece[2])
    for place, tier in enumerate(tiers):
        while pools[tier]:
            window = [pools[tier].pop()]
            gap = tier - window[0][2]
            while gap:
                fits = next((t for t in tiers[place:] if t <= gap and pools[t]), None)
                source = fits or next((t for t in reversed(tiers[place:]) if pools[t]), None)
                if source is None:
                    break
                text, start, length = pools[source].pop()
                taken = min(length, gap)
                window.append((text, start, taken))
                route(text, start + taken, length - taken)
                gap -= taken
            windows += [window] if not gap else split(window, tier - gap)
    return windows


def split(window: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """Cut a window that nothing can fill into ones whose lengths are powers of two."""
    out, pieces = [], list(reversed(window))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            text, start, length = pieces.pop()
            taken = min(length, room)
            part.append((text, start, taken))
            room -= taken
            if taken < length:
                pieces.append((text, start + taken, length - taken))
        out.append(part)
    return out


def cell_rows(ids: list[bytes], first: int, steps: int, tiers, step_tokens: int) -> tuple[list, list, int, int]:
    """Rows of a cell: (text, start, length, crc, text length, window, offset, size, step)."""
    lengths = [len(i) // 4 for i in ids]
    windows = pack(lengths, tiers)
    sizes = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda w: -sizes[w])
    rows, texts, filled = [], [], 0
    for number, w in enumerate(order):
        offset = 0
        for text, start, length in windows[w]:
            crc = zlib.crc32(ids[text][4 * start:4 * (start + length)])
            texts.append(text)
            rows.append((
                start, length, crc, lengths[text], first + number, offset, sizes[w],
                steps + filled // step_tokens,
            ))
            offset += length
        filled += sizes[w]
    return texts, rows, first + len(windows), steps + -(-filled // step_tokens)


def pack_documents(
    docs: DataFrame, path: str, end_id: int | None, column: str = "text",
    keep: tuple[str, ...] = ("doc_id",), tiers: tuple[int, ...] = TIERS,
    cell_tokens: int = CELL_TOKENS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: where it lies in its text and in its window.

    ``sequence_id`` and ``step_group`` hold the task's number in their upper
    half.  A null text is an empty one: it holds only the end id, or nothing if
    there is none and then gets no row.  ``docs`` should be a scan, whose tasks
    read the same rows again after a lost executor.  ``step_tokens`` should be a
    multiple of the longest tier, and the tiers powers of two, longest first.
    """
    added = StructType.fromDDL(COLUMNS)
    narrow = docs.select(*[docs[c] for c in keep], docs[column].cast("string").alias("__text"))
    result = StructType([*narrow.schema.fields[:-1], *added.fields])
    kinds = list(to_arrow_schema(added).types)

    def run(batches):
        encode = WordIds(path, end_id)
        base = TaskContext.get().partitionId() << 32
        state = [0, 0]

        def packed(kept, ids):
            texts, rows, state[0], state[1] = cell_rows(ids, *state, tiers, step_tokens)
            if not rows:
                return
            head = pa.Table.from_batches(kept).combine_chunks().take(pa.array(texts, pa.int64()))
            cols = [np.array(c, np.int64) for c in zip(*rows)]
            cols[4] += base
            cols[7] += base
            table = pa.table(
                [*head.columns, *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=result.fieldNames(),
            )
            yield from table.to_batches(max_chunksize=10_000)

        kept, ids, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "__text"):
                made = encode(part.column("__text").to_pylist())
                kept.append(part.select(list(range(len(keep)))))
                ids += made
                held += sum(map(len, made)) // 4
                if held >= cell_tokens:
                    yield from packed(kept, ids)
                    kept, ids, held = [], [], 0
        if ids:
            yield from packed(kept, ids)

    return narrow.mapInArrow(run, result)
