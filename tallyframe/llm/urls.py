"""Filter URLs by host rules and, where none fits, by a model of their characters.

The model is a logistic regression on hashed character n-grams of host and path,
fitted in numpy on a small labelled table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
MOST_LABELLED = 20_000
PATH_WEIGHT = 0.25  # of a path against its host
BLOCK_FROM = 0.5  # hosts kept out of training are told apart by limits from 0.3 to 0.6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (verdict, host, path); the longest rule that fits decides.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Words of the labelled table (fixed values).
UNWANTED = (
    "casino bets poker jackpot slots roulette lottery adult porn xxx escort webcam pills viagra pharmacy "
    "spam adserver popunder clickbait tracker warez torrent crack payday loan replica"
).split()
WANTED = (
    "news library garden school history weather recipes museum travel science council hospital "
    "forum archive football music planet bakery theatre gazette letters railway harbour gallery "
    "university kitchen market village nature chess poetry orchard painter novel station teacher "
    "brewery pottery local blog shop photo studio review journal notes"
).split()
# Parts that hosts of both labels share, before and after the word.
BEFORE, AFTER = ("", "best-", "my", "the", "online-", "top"), ("", "-room", "24", "-online", "hub", "world")
PREFIXES, ENDINGS, FOLDERS = ("www.", "", "blog.", "m."), ("com", "org", "net"), ("en", "de", "fr", "es")
PAGES = ("index", "wiki/page", "2021/07", "item/view", "a/b/c")


def labelled_urls(held_out: bool = False) -> list[tuple[str, int]]:
    """The small labelled table: every word in six hosts, 1 for unwanted words.

    Prefix, ending, parts beside the word and path go round without regard to
    the label.  ``held_out`` gives hosts that the table does not hold: the same
    words beside other parts, with other paths.
    """
    words = [(w, 1) for w in UNWANTED] + [(w, 0) for w in WANTED]
    shift = 3 if held_out else 0
    return [
        (f"https://{PREFIXES[(i + k) % 4]}{BEFORE[k]}{word}{AFTER[(k + i % 3 + shift) % 6]}."
         f"{ENDINGS[(i + 2 * k) % 3]}/{FOLDERS[(i + 3 * k) % 4]}/{PAGES[(2 * i + k + shift) % 5]}"
         f"/{100 + 37 * i + k + shift}", label)
        for i, (word, label) in enumerate(words) for k in range(6)
    ]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule = F.when(fits, of + start).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def ngrams(texts: list[str], salt: int, sizes: Sequence[int] = SIZES, buckets: int = BUCKETS):
    """Hashed n-grams of all texts as (owner, bucket); each text is framed by line feeds."""
    data = [b"\n" + t.encode() + b"\n" for t in texts]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(data)), lengths)
    room = ends[owner] - np.arange(len(flat)) if len(flat) else np.empty(0, np.int64)
    owners, found = [], []
    for size in sizes:
        count = len(flat) - size + 1
        if count <= 0:
            continue
        value = np.full(count, salt * 64 + size, np.uint64)
        for i in range(size):
            value = (value ^ flat[i:i + count]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(31)
        inside = room[:count] >= size
        owners.append(owner[:count][inside])
        found.append((value[inside] % np.uint64(buckets)).astype(np.int64))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(found)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of hosts and paths as (owner, bucket, value).

    Values of a host's n-grams, and apart from them of a path's, are scaled by
    the root of their number, so that a long path does not thin out its host.
    """
    owners, buckets, values = [], [], []
    for salt, texts, weight in ((1, hosts, 1.0), (2, paths, PATH_WEIGHT)):
        owner, bucket = ngrams(texts, salt)
        count = np.bincount(owner, minlength=len(texts))
        owners.append(owner)
        buckets.append(bucket)
        values.append(weight / np.sqrt(np.maximum(count, 1))[owner])
    return np.concatenate(owners), np.concatenate(buckets), np.concatenate(values)


class Model:
    """Weights per bucket and a bias; host and path add up."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def probabilities(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        return self.scored(features(hosts, paths), len(hosts))

    def scored(self, made: tuple[np.ndarray, np.ndarray, np.ndarray], count: int) -> np.ndarray:
        owner, bucket, value = made
        total = np.bincount(owner, self.weights[bucket] * value, minlength=count)
        return 1 / (1 + np.exp(-(total + self.bias)))


def fit(hosts: list[str], paths: list[str], labels: Sequence[int], rounds: int = 300,
        rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Gradient descent on the mean logistic loss with decay; the same each time."""
    wanted = np.asarray(labels, np.float64)
    made = features(hosts, paths)
    owner, bucket, value = made
    model = Model(np.zeros(BUCKETS), 0.0)
    for _ in range(rounds):
        error = model.scored(made, len(hosts)) - wanted
        model.weights -= rate * (
            np.bincount(bucket, error[owner] * value, minlength=BUCKETS) / len(wanted) * 20
            + decay * model.weights
        )
        model.bias -= rate * error.mean()
    return model


def train(labelled: DataFrame, rounds: int = 300) -> Model:
    """A model from a table of (url, label); at most ``MOST_LABELLED`` rows, drawn by a hash, are used.

    Rows without url or label are left out.  Without any row the model allows all.
    """
    rows = (
        labelled.select(
            host_of(labelled["url"]).alias("host"), path_of(labelled["url"]).alias("path"),
            labelled["label"].cast("int").alias("label"),
        ).where("host is not null and label is not null")
        .orderBy(F.xxhash64("host", "path", "label"), "host", "path", "label")
        .limit(MOST_LABELLED).collect()
    )
    if not rows:
        return Model(np.zeros(BUCKETS), -1.0)
    return fit([r.host for r in rows], [r.path for r in rows], [r.label for r in rows], rounds)


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def judge_urls(
    pages: DataFrame, model: Model, rules: Sequence[tuple[str, str, str]] = RULES,
    url: str = "url", keep: tuple[str, ...] = ("page_id",), block_from: float = BLOCK_FROM,
) -> DataFrame:
    """Append ``host``, ``path``, ``rule``, ``verdict`` and the model's ``score``.

    A null url, or one without ``://``, has an empty host and path and is judged
    by the model's bias.  Every row is judged, repeated ones alike.
    """

    split = pages.select(
        *[pages[c] for c in keep],
        F.coalesce(host_of(pages[url]), F.lit("")).alias("host"),
        F.coalesce(path_of(pages[url]), F.lit("")).alias("path"),
    )
    held = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(held.value.probabilities(host.tolist(), path.tolist()))

    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    scored = split.withColumn("score", score("host", "path"))
    return scored.select(
        *keep, "host", "path", rule.alias("rule"),
        F.coalesce(ruled, F.when(F.col("score") >= block_from, "block").otherwise("allow")).alias("verdict"),
        "score",
    )

