"""Benchmark passages in documents, found by winnowing.

Of every ``NEAR`` consecutive hashes of ``GRAM`` words the smallest is kept as a
fingerprint.  The choice depends on those words alone, so a span of
``GRAM + NEAR - 1`` words that a document shares with an item leaves the same
fingerprint in both: with 5 and 6 no shared window of ten words is missed.
Fingerprints of both sides are joined on their hash, and every hit is extended
word by word, so a result rests on equal words and not on equal hashes.  An item
shorter than a window is fingerprinted by the hash of all its words, and so are
the document's spans of that many words.

The items are read in blocks of bounded size, which tasks hold as sorted arrays;
one pass over the documents joins them with one block, and nothing is shuffled
while one block holds all.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import map_texts
from tallyframe.sources.staging import staged

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 4 << 20

# Bytes that are no part of a word become spaces; capitals are lowered before.
_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_WORD_BYTES).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out *= np.uint64(_MIX[0])
        out += hashes[i:i + count]
        out ^= out >> np.uint64(29)
    out *= np.uint64(_MIX[1])
    return out ^ (out >> np.uint64(32))


def winnow(grams: np.ndarray, near: int) -> np.ndarray:
    """Places of the smallest hash in every ``near`` consecutive ones, the rightmost on a tie."""
    if len(grams) < near:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, near)[:, ::-1]
    places = np.arange(len(views)) + near - 1 - views.argmin(axis=1)
    return places[np.concatenate(([True], places[1:] != places[:-1]))]


class Index:
    """The fingerprints of a block of items, sorted by hash."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids, self.words, self.short = [], [], set()
        hashes, owners, places = [], [], []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            all_hashes = word_hashes(words)
            if len(words) < window:
                self.short.add(len(words))
                grams, at = gram_hashes(all_hashes, len(words)), np.zeros(1, np.int64)
            else:
                grams = gram_hashes(all_hashes, gram)
                at = winnow(grams, window - gram + 1)
            hashes.append(grams[at])
            owners.append(np.full(len(at), len(self.ids), np.int64))
            places.append(at)
            self.ids.append(item)
            self.words.append(words)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owners = np.concatenate(owners)[order] if owners else np.empty(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.empty(0, np.int64)

    def joined(self, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of places: in ``hashes`` and in the index, with equal hashes."""
        low = np.searchsorted(self.hashes, hashes, "left")
        here = np.flatnonzero(low < len(self.hashes))
        here = here[self.hashes[low[here]] == hashes[here]]
        high = np.searchsorted(self.hashes, hashes[here], "right")
        for place, start, stop in zip(here.tolist(), low[here].tolist(), high.tolist()):
            for entry in range(start, stop):
                yield place, entry

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Word count, hit spans as (start, end) and the items that occur."""
        words = words_of(text)
        spans, found = set(), set()
        if not words or not len(self.hashes):
            return len(words), [], found
        hashes = word_hashes(words)
        grams = gram_hashes(hashes, self.gram)
        at = winnow(grams, self.window - self.gram + 1)
        reached = defaultdict(int)  # the end of the last run on each alignment
        for place, entry in self.joined(grams[at]):
            item = int(self.owners[entry])
            theirs = self.words[item]
            if len(theirs) < self.window:
                continue
            i, j = int(at[place]), int(self.places[entry])
            if i < reached[item, i - j]:
                continue
            start, stop = i, i
            while stop < len(words) and j + stop - i < len(theirs) and words[stop] == theirs[j + stop - i]:
                stop += 1
            while start and j + start - i and words[start - 1] == theirs[j + start - 1 - i]:
                start -= 1
            reached[item, i - j] = max(stop, i + 1)
            if stop - start >= self.window:
                spans.add((start, stop))
                found.add(self.ids[item])
        for size in self.short:
            for i, entry in self.joined(gram_hashes(hashes, size)):
                theirs = self.words[int(self.owners[entry])]
                if len(theirs) == size and words[i:i + size] == theirs:
                    spans.add((i, i + size))
                    found.add(self.ids[int(self.owners[entry])])
        return len(words), sorted(spans), found


def covered(spans: list) -> int:
    """How many places the spans cover together."""
    total = end = 0
    for start, stop in sorted(map(tuple, spans)):
        total += max(0, stop - max(start, end))
        end = max(end, stop)
    return total


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def block_of(items: DataFrame, block: int, count: int) -> list[tuple[str, str]]:
    """The items of one block, dealt by id and text: one id may hold most of the benchmark."""
    part = items
    if count > 1:
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block)
    return [(row.item, row.text) for row in part.collect()]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Append ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A null or empty text has no words and hits nothing; an item without words
    never occurs.  Items that share an id count once; one without id is named by
    an empty string.  The driver holds one block of items at a time.  When the
    measured total asks for several blocks, the different items and the documents,
    these with a row number, are written once, each block is joined with all
    documents, and the spans found are put together by row.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"),
        benchmark["text"].cast("string").alias("text"),
    ).where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes) or 1
    if count == 1:
        index = spark.sparkContext.broadcast(Index(block_of(items, 0, 1), window, gram))

        def make():
            held = index.value

            def work(texts):
                found = [held.hits(t) for t in texts]
                return [
                    [n for n, _, _ in found], [covered(spans) for _, spans, _ in found],
                    [len(ids) for _, _, ids in found], [digest(ids) for _, _, ids in found],
                ]

            return work

        out = map_texts(
            docs, column, make,
            "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string", list(keep),
        )
        return out.withColumn("contaminated", F.col("n_hit") > 0)

    # Repeated items would all fall into one block.
    items = staged(items.dropDuplicates(["item", "text"]), "benchmark-items")
    numbered = staged(
        docs.select(
            F.struct(*[docs[c] for c in keep]).alias("kept"), docs[column].alias("text"),
            F.monotonically_increasing_id().alias("row"),
        ), "passages-in",
    )
    passes = []
    for block in range(count):
        index = spark.sparkContext.broadcast(Index(block_of(items, block, count), window, gram))

        def make(index=index):
            held = index.value

            def work(texts):
                found = [held.hits(t) for t in texts]
                return [
                    [n for n, _, _ in found], [spans for _, spans, _ in found],
                    [sorted(ids) for _, _, ids in found],
                ]

            return work

        passes.append(staged(map_texts(
            numbered, "text", make,
            "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>",
            ["row"],
        ).where((F.size("spans") > 0) | F.lit(block == 0)), "passages"))
        index.unpersist()
    merged = reduce(DataFrame.unionByName, passes).groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return numbered.drop("text").join(merged, "row").select(
        "kept.*", "n_words",
        F.expr(
            "aggregate(spans, named_struct('total', 0L, 'end', 0L), (a, s) -> named_struct("
            "'total', a.total + greatest(0L, s.stop - greatest(s.start, a.end)), "
            "'end', greatest(a.end, s.stop)), a -> a.total)"
        ).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
