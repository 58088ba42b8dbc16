"""Shards of nearly equal row counts that keep linked documents together.

Documents are linked by a group key.  In each round of label propagation a join
shows every document how its group's members are spread; it proposes to move to
the shard that holds most of them, and as many proposals are taken as the
shard's quota leaves room for.  A group larger than a quota aims at as few
shards as can hold it.  At the end documents without links, and only if need be
linked ones, move from shards above their quota to those below, so that counts
differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.sources.staging import staged

ROUNDS = 5
ROWS_A_BUCKET = 50_000


def _draw(*what: Column) -> Column:
    """A number in [0, 1) that depends on the arguments alone."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 30)) / float(1 << 30)


def numbered(df: DataFrame, by: list[str], row: str, count: int, name: str) -> DataFrame:
    """Number the rows of each ``by`` from 0 without gaps.

    Rows are dealt to buckets of bounded size by a hash of their unique ``row``;
    bucket counts are summed up, and only within a bucket rows are sorted.
    """
    buckets = max(1, -(-count // ROWS_A_BUCKET))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(row), F.lit(buckets)))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = dealt.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*by, "__bucket").orderBy(row)
    return (
        dealt.join(starts, [*by, "__bucket"])
        .withColumn(name, F.col("__start") + F.row_number().over(within) - 1)
        .drop("__bucket", "__start")
    )


def _counts(df: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.n for r in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _pick(values: list, index: Column) -> Column:
    """The value of a short list at an index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def balanced_shards(rows: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Append ``shard`` and ``slot`` to a table with a unique ``row`` and a ``group``.

    A null group has no links.  ``rows`` should be a written table.  Counts of
    shards differ by at most one; slots of a shard are gapless from 0.  Only
    counts per shard reach the driver.
    """
    total = rows.count()
    if not total:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = rows.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("__size"))
    state = staged(
        rows.join(sizes.where("__size > 1"), "group", "left")
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")),
        "shards",
    )
    linked, free = state.where("__size is not null"), state.where("__size is null")
    for number in range(rounds):
        votes = linked.groupBy("group", "__size", "shard").agg(F.count(F.lit(1)).alias("n"))
        most = votes.groupBy("group", "__size").agg(
            F.max(F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")).alias("best")
        )
        span = F.ceil(F.col("__size") / float(max(quota)))
        aim = most.select("group", F.col("best.shard").alias("aim"), span.alias("span"))
        proposed = linked.join(aim, "group").withColumn(
            "aim",
            F.pmod(F.col("aim") + F.floor(_draw(F.col("row"), F.lit("span")) * F.col("span")), F.lit(shards)).cast("int"),
        ).drop("span")
        proposed = staged(proposed, "proposals")
        staying = _counts(proposed.where("shard = aim"), shards)
        wanted = _counts(proposed.where("shard != aim").select(F.col("aim").alias("shard")), shards)
        if not sum(wanted):
            break
        share = [
            min(1.0, max(0.0, (q - s) / w)) if w else 0.0 for q, s, w in zip(quota, staying, wanted)
        ]
        # Small groups are taken as a whole, those beyond a quota by document.
        drawn = F.when(
            F.col("__size") > max(quota), _draw(F.col("row"), F.lit(number))
        ).otherwise(_draw(F.col("group"), F.lit(number)))
        linked = proposed.withColumn(
            "shard", F.when(drawn < _pick(share, F.col("aim")), F.col("aim")).otherwise(F.col("shard"))
        ).drop("aim")
        linked = staged(linked, "shards")
    # Linked documents hold their shard first, the others fill it up.
    held = _counts(linked, shards)
    room = [max(0, q - h) for q, h in zip(quota, held)]
    placed = numbered(linked, ["shard"], "row", total, "__place").withColumn(
        "__over", F.col("__place") >= _pick(quota, F.col("shard"))
    ).unionByName(
        numbered(free, ["shard"], "row", total, "__place").withColumn(
            "__over", F.col("__place") >= _pick(room, F.col("shard"))
        )
    )
    placed = staged(placed.drop("__place", "__size"), "placed")
    kept = _counts(placed.where("not __over"), shards)
    moving = numbered(placed.where("__over").withColumn("__all", F.lit(0)), ["__all"], "row", total, "__place")
    to, until = F.lit(0), 0
    for s in range(shards - 1):
        until += quota[s] - kept[s]
        to += (F.col("__place") >= until).cast("int")
    settled = placed.where("not __over").unionByName(
        moving.withColumn("shard", to.cast("int")).drop("__place", "__all")
    )
    return numbered(settled.drop("__over"), ["shard"], "row", total, "slot")


def cut_links(sharded: DataFrame) -> DataFrame:
    """Per group of several documents: its size and how many lie outside its main shard."""
    spread = sharded.where("group is not null").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    return spread.groupBy("group").agg(
        F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("outside")
    ).where("size > 1")


def shard_documents(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shards for documents whose equal texts are linked, under the law ``rows``.

    A null text has size 8, the checksum of an empty text and no links; rows
    that repeat an id are sharded each.  An empty table gives an empty result.
    """
    content = docs[text].cast("string")
    rows = staged(
        docs.select(
            docs[key].alias("key"),
            (F.coalesce(F.octet_length(content), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(content, F.lit("")).cast("binary")).alias("text_crc32"),
            F.sha2(content, 256).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        ), "rows",
    )
    return balanced_shards(rows, shards).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
