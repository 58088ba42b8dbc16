"""Near-duplicate texts: banded MinHash candidates, sequential Bayesian verification.

A text's set holds the hashes of its distinct word shingles; texts with equal
sets are one class and only its smallest id goes on.  Classes that agree on all
values of a band of the signature share a bucket.

1. Of buckets with the same members one goes on.  In each, one member is the
   pivot, drawn by a hash, and every other member is a candidate with it: at most
   as many pairs as memberships, whatever a bucket's size.  Buckets draw apart, so
   that a member who misses the threshold to one pivot meets others.
2. Candidates are compared by batches of signature values.  With a uniform prior
   the posterior of the similarity after ``m`` of ``n`` agreements is a Beta
   distribution; a pair is given up once the probability that it reaches the
   threshold falls below ``MISS``.  Survivors are verified on their whole sets.
3. Most buckets now lie within one component.  In the others, members outside
   the bucket's largest component are compared with all members of other
   components, two blocks of bounded bytes at a time: signatures first, then
   whole sets, and a pair of blocks returns only a spanning forest.  So no link is lost but with a probability of
   the order of 1e-6: a pair at the threshold shares no bucket with probability
   (1 - 0.85**5)**25 = 4e-7 and is given up with about ``MISS`` a batch.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import map_texts
from tallyframe.llm.graph import components
from tallyframe.operators.sieve import key_field, may_match
from tallyframe.sources.staging import staged

BANDS, ROWS = 25, 5
MISS = 1e-6
BATCH = 25
BLOCK_BYTES = 16 << 20
SEED = 20_011

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs without space and \\t \\n \\v \\f \\r."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; a shorter text is one run."""
    import xxhash

    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    wide = min(size, len(hashes))
    out = np.full(len(hashes) - wide + 1, wide, np.uint64)
    for i in range(wide):
        out *= np.uint64(_ODD[0])
        out += hashes[i:i + len(out)]
        out ^= out >> np.uint64(31)
    out *= np.uint64(_ODD[3])
    out ^= out >> np.uint64(29)
    return np.unique(out)


def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The smallest of the set under each of several multiplicative hashes, 16 of its middle bits.

    The upper bits of a minimum are nearly all zero for large sets; the middle ones
    agree by chance once in 65,536 times, which can only keep a pair.
    """
    out = np.full(len(by), np.uint64(2**64 - 1))
    for at in range(0, len(values), 512):
        np.minimum(out, (values[at:at + 512, None] * by).min(axis=0), out=out)
    return ((out >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)


def least_agreements(threshold: float, miss: float, total: int, batch: int) -> list[tuple[int, int]]:
    """(n, m): after n values, pairs with fewer than m agreements are given up.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and it exceeds
    the threshold t with the probability that a binomial (n + 1, t) is at most m.
    """
    out = []
    for n in [*range(batch, total, batch), total]:
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss or m > n:
                break
            m += 1
        out.append((n, m))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


def survivors(a: np.ndarray, b: np.ndarray, stops: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature arrays are not given up at any batch."""
    alive, agreed, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in stops:
        agreed = agreed + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        near = agreed >= least
        alive, agreed, done = alive[near], agreed[near], n
    return alive


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def shingle_table(docs: DataFrame, text: str, key: str, size: int, values: int) -> DataFrame:
    """(id, n_shingles, class, signature): the class names the set; null for empty sets."""

    def make():
        import xxhash

        by = multipliers(values)

        def work(texts):
            sets = [shingles(t, size) for t in texts]
            return [
                [len(s) for s in sets],
                [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                [signature(s, by).tobytes() if len(s) else None for s in sets],
            ]

        return work

    named = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    return map_texts(
        named, "text", make, "n_shingles bigint, class binary, signature binary", ["id"]
    )


def set_table(docs: DataFrame, ids: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(id, set) of the documents named by ``ids`` (id, class), from their whole texts.

    Texts stay where they are: a sieve of the ids tells which become sets, and the
    sets of the few others that it lets through go in the join.
    """

    def make():
        import xxhash

        def work(texts):
            sets = [shingles(t, size).tobytes() for t in texts]
            return [[xxhash.xxh3_128_digest(s) for s in sets], sets]

        return work

    named = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    found = map_texts(sieved(named, ids, "id"), "text", make, "class binary, set binary", ["id"])
    return found.join(ids, ["id", "class"], "left_semi").dropDuplicates(["id", "class"]).drop("class")


def sieved(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key may be one of ``keys``: all that are, and a few that are not."""
    return may_match(df, [F.col(key)], key_field(keys, [F.col(key)]))


def memberships(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, id): a class lies in one bucket of every band."""

    def cut(batches):
        for part in batches:
            if not len(part):
                continue
            values = _signatures(part["signature"]).reshape(len(part), bands, rows)
            mixed = np.zeros((len(part), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for i in range(rows):
                mixed = (mixed + values[:, :, i]) * np.uint64(_ODD[0])
                mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(_ODD[3])
            mixed ^= mixed >> np.uint64(32)
            yield pd.DataFrame({"id": part["id"], "buckets": list(mixed.view(np.int64))})

    return classes.select("id", "signature").mapInPandas(cut, "id long, buckets array<long>").select(
        "id", F.explode("buckets").alias("bucket")
    )


def pruned(pairs: DataFrame, signatures: DataFrame, stops: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) that the sequential test does not give up."""
    both = pairs.join(signatures.toDF("a", "sig_a"), "a").join(signatures.toDF("b", "sig_b"), "b")

    def prune(batches):
        for part in batches:
            if len(part):
                alive = survivors(_signatures(part["sig_a"]), _signatures(part["sig_b"]), stops)
                yield part[["a", "b"]].iloc[alive]

    return both.mapInPandas(prune, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def verify(batches):
        for part in batches:
            holds = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(part["set_a"], part["set_b"])
            ]
            yield part[["a", "b"]][np.array(holds, bool)]

    return both.mapInPandas(verify, "a long, b long")


def block_links(rows: pd.DataFrame, stops: list[tuple[int, int]], percent: int) -> pd.DataFrame:
    """A spanning forest of the links between two blocks of a bucket.

    Rows of the ``low`` block are compared with those of the ``high`` one that lie
    in other components, and, where ``within`` says so, with each other.
    """
    ids, low = rows["id"].to_numpy(), rows["low"].to_numpy() == rows["block"].to_numpy()
    within = bool(rows["within"].iloc[0])
    component = rows["component"].to_numpy().copy()
    signatures = _signatures(rows["signature"])
    sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
    places, out = np.arange(len(ids)), []
    for i in np.flatnonzero(low):
        other = ~low | (places > i) if within else ~low
        j = np.flatnonzero(other & (component != component[i]))
        if len(j):
            some = np.broadcast_to(signatures[i], (len(j), signatures.shape[1]))
            j = j[survivors(some, signatures[j], stops)]
        for k in j:
            if component[k] != component[i] and similar(sets[i], sets[k], percent):
                out.append((ids[i], ids[k]))
                component[component == component[k]] = component[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def block_pairs(members: DataFrame, sizes: DataFrame, block_bytes: int) -> DataFrame:
    """Members (bucket, id, component, probe) dealt to pairs of blocks (low, high).

    Probes and the others go to blocks of their own, of about ``block_bytes`` by
    ``sizes`` (id, bytes); probe blocks have the lower numbers.  Every probe block
    meets every higher block once, and is compared ``within`` itself where it
    meets the next one, so two rows meet once if one of them is a probe.
    """
    sized = members.join(sizes, "id")
    wanted = [
        F.greatest(F.lit(1).cast("long"), F.ceil(F.sum(F.when(side, F.col("bytes"))) / block_bytes))
        for side in (F.col("probe"), ~F.col("probe"))
    ]
    counts = sized.groupBy("bucket").agg(wanted[0].alias("probes"), wanted[1].alias("others"))
    zero, drawn = F.lit(0).cast("long"), F.xxhash64("id")
    block = F.when(F.col("probe"), F.pmod(drawn, F.col("probes"))).otherwise(
        F.col("probes") + F.pmod(drawn, F.col("others"))
    )
    last = F.when(F.col("probe"), F.col("probes") + F.col("others")).otherwise(F.col("probes")) - 1
    return (
        members.join(counts, "bucket")
        .select("bucket", "id", "component", block.alias("block"), F.explode(F.sequence(zero, last)).alias("met"))
        .where("met != block")
        .select(
            "bucket", "id", "component", "block", F.least("block", "met").alias("low"),
            F.greatest("block", "met").alias("high"),
        ).withColumn("within", F.col("high") == F.col("low") + 1)
    )


def rest_links(
    buckets: DataFrame, joined: DataFrame, signatures: DataFrame, sets: DataFrame,
    stops: list[tuple[int, int]], percent: int, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Links between members of one bucket that lie in different components.

    Such a pair has a member outside the bucket's largest component, a probe.
    A task holds two blocks of bounded bytes, whatever a bucket's size.
    """
    labelled = buckets.join(joined.toDF("id", "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    mixed = (
        labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bucket").agg(
            F.max(F.struct("n", "component")).getField("component").alias("main"),
            F.count(F.lit(1)).alias("components"), F.sum("n").alias("members"),
        ).where("components > 1 and members > 2").select("bucket", "main")
    )
    members = staged(
        labelled.join(mixed, "bucket")
        .select("bucket", "id", "component", (F.col("component") != F.col("main")).alias("probe")),
        "open-buckets",
    )
    sizes = sets.select("id", (F.octet_length("set") + 2 * stops[-1][0]).alias("bytes"))
    dealt = block_pairs(members, sizes, block_bytes)
    return (
        dealt.join(signatures, "id").join(sets, "id").groupBy("bucket", "low", "high")
        .applyInPandas(lambda rows: block_links(rows, stops, percent), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, percent: int = 85,
    bands: int = BANDS, rows: int = ROWS, miss: float = MISS,
) -> DataFrame:
    """Per row: key, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked if ``percent`` of the union of their shingle sets is common.
    A text without words, also a null one, has an empty set and is its own
    component.  A row without id gets its count, no component and is not kept.
    Rows that share an id are one node.  An empty table gives an empty result.
    """
    stops = least_agreements(percent / 100, miss, bands * rows, BATCH)
    table = staged(shingle_table(docs, text, key, words, bands * rows), "shingles")
    named = table.where("class is not null and id is not null")
    classes = staged(
        named.groupBy("class").agg(F.min("id").alias("id"), F.any_value("signature").alias("signature")),
        "classes",
    )
    # Most classes are alone in their buckets: only counts by bucket are shuffled of those.
    all_members = memberships(classes, bands, rows)
    filled = all_members.groupBy("bucket").count().where("count > 1")
    crowd = staged(sieved(all_members, filled, "bucket"), "crowd")
    draw = F.struct(F.xxhash64("bucket", "id").alias("draw"), "id")
    several = crowd.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.min(draw).getField("id").alias("pivot"),
        F.bit_xor(F.xxhash64("id")).alias("mix"), F.bit_xor(F.xxhash64(F.lit(SEED), "id")).alias("mixed"),
    ).where("members > 1")
    # Equal members, told by 128 bits, have nothing to add in a second bucket.
    shared = several.groupBy("members", "mix", "mixed").agg(
        F.min(F.struct("bucket", "pivot")).alias("one")
    ).select("members", "one.bucket", "one.pivot")
    buckets = staged(crowd.join(shared, "bucket"), "buckets")
    signatures = staged(sieved(classes.select("id", "signature"), buckets, "id"), "signatures")
    stars = buckets.where("id != pivot").select(
        "bucket", F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")
    )
    near = staged(pruned(stars.select("a", "b").distinct(), signatures, stops), "near")
    # Sets are needed of all pairs left, and of buckets that some pair given up leaves open.
    ruled_out = stars.join(near, ["a", "b"], "left_anti").select("bucket").distinct()
    needed = near.select(F.col("a").alias("id")).union(near.select("b")).union(
        buckets.where("members > 2").join(ruled_out, "bucket", "left_semi").select("id")
    ).distinct()
    wanted = staged(classes.select("id", "class").join(needed, "id", "left_semi"), "wanted")
    sets = staged(set_table(docs, wanted, text, key, words), "sets")
    links = staged(verified(near, sets, percent), "links")
    first = components(links)
    more = staged(
        rest_links(buckets.select("bucket", "id"), first, signatures, sets, stops, percent), "links"
    )
    # The stars found first stand for the links they came from.
    joined = components(first.toDF("a", "b").union(more))
    per_class = classes.select("class", "id").join(joined.toDF("id", "component"), "id", "left").select(
        "class", F.coalesce("component", "id").alias("component")
    )
    found = table.select("id", "n_shingles", "class").join(per_class, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
