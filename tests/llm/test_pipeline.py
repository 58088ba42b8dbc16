"""The pipeline's stages against brute force, each on its predecessor's rows."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_contracts import base_spans, brute_passages, components_of, shingle_set
from test_sieve import exchanges

from tallyframe.llm import minhash, pii
from tallyframe.operators import sieve
from tallyframe.sources.files import load
from tallyframe.sources.staging import staged


@pytest.fixture(scope="module")
def steps(spark, data_dir):
    docs = load(spark, data_dir, "documents")
    found = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, data_dir), name)
        found[name] = docs.toPandas()
    return found


def texts(frame):
    return dict(zip(frame.doc_id, frame.text))


def test_language_keeps_documents_with_letters(steps):
    before, after = texts(steps["documents"]), texts(steps["language_id"])
    assert list(steps["language_id"].columns) == list(steps["documents"].columns)
    assert all(before[d] == t for d, t in after.items())
    assert {d for d, t in before.items() if t and re.search(r"[^\W\d_]", t)} == set(after)


def test_language_keeps_clean_texts_of_many_languages(spark):
    """Twelve languages share the probability, so that no score is high; all texts stay."""
    draw = np.random.default_rng(3)
    rows = []
    for number in range(12):
        letters = draw.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:11]
        for i in range(20):
            words = ["".join(draw.choice(letters, 5)) for _ in range(40)]
            rows.append((12 * i + number, " ".join(words), f"l{number}", "s", 239))
    rows += [(900, "123 456", None, "s", 7), (901, None, "l1", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.language_id(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(240))


def test_near_dedup(steps):
    before = texts(steps["language_id"])
    sets = {d: shingle_set(t, 5) for d, t in before.items()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    of = components_of(sets, links)
    after = texts(steps["near_dedup"])
    assert links and after == {d: t for d, t in before.items() if of[d] == d}


@pytest.mark.parametrize("bits", [None, 8])
def test_near_dedup_leaves_texts_where_they_are(spark, monkeypatch, bits):
    """Only rows that may have a partner are shuffled; a full bit field lets all through, with the same result."""
    draw = random.Random(4)
    rows = [(i, " ".join(f"w{draw.randrange(9999)}" for _ in range(60)), "p", i) for i in range(300)]
    rows += [(300 + i, rows[i][1] + (" more" if i % 2 else ""), "q", i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, bits long")
    moved = {}

    def traced(df, label):
        moved.setdefault(label, []).extend(exchanges(df))
        return staged(df, label)

    monkeypatch.setattr(minhash, "staged", traced)
    if bits:
        monkeypatch.setattr(sieve, "FIELD_BITS", bits)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline.near_dedup(spark, docs, "")
        last = exchanges(left)
        assert left.columns == docs.columns
        assert sorted(tuple(r) for r in left.collect()) == rows[:300]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if not bits:
        # Of all memberships (28 a class) only the counts move, once.
        large = [n for some in moved.values() for n in some if n > 1000]
        assert len(large) == 1 and large[0] <= 28 * 306
        assert all(max(moved[label]) < 100 for label in ("near", "sets")) and max(last) < 100


def test_decontamination(spark, data_dir, steps):
    before = texts(steps["near_dedup"])
    benchmark = load(spark, data_dir, "benchmark").toPandas()
    hit = {d for d, row in brute_passages(before.items(), zip(benchmark.item_id, benchmark.text)) if row[4]}
    assert hit and texts(steps["decontamination"]) == {d: t for d, t in before.items() if d not in hit}


def test_pii(steps):
    before, after = texts(steps["decontamination"]), texts(steps["pii"])
    assert set(before) == set(after) and before != after
    for d, text in before.items():
        assert after[d] == pii.mask(text, pii.find(text), corpus_pipeline.LEAST_PII_SCORE)
        assert not base_spans(after[d])
        if not base_spans(text) and len(pii.find(text)) == 0:
            assert after[d] == text
    assert (steps["pii"].n_chars == steps["pii"].text.str.len()).all()


def test_packing(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = steps["packing"].sort_values(["doc_id", "start"]).groupby("doc_id")
    kept = texts(steps["pii"])
    assert set(pieces.groups) == set(kept)
    for d, some in pieces:
        ids = np.array([*tokenizer.encode(kept[d], add_special_tokens=False).ids, 2], "<u4")
        assert some.length.sum() == len(ids)
        for row in some.itertuples():
            assert row.ids_crc32 == zlib.crc32(ids[row.start:row.start + row.length].tobytes())


def test_run_equals_its_stages(spark, data_dir, steps):
    ours = corpus_pipeline.run(spark, data_dir).toPandas()
    assert set(ours.doc_id) == set(steps["packing"].doc_id)
    assert ours.length.sum() == steps["packing"].length.sum()


def test_odd_rows(spark, data_dir):
    """Nulls, empty and repeated rows, extra columns; and no rows at all."""
    text = "The thing and the other of that " * 8
    rows = [
        (1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (2, None, None, None, None, None),
        (3, "", "en", None, 0, "y"), (None, text + "more words here", "en", "a", 1, "z"),
        (4, "12 34 --", None, "b", 8, None), (5, "zürich " * 3000, "de", "b", 1, "k"),
    ]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, data_dir), f"odd-{name}")
            if name != "packing":
                assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            if name == "near_dedup" and some:
                assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 5]
        assert (docs.count() > 0) == bool(some)
