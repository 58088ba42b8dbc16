"""Nulls, empty and very long texts, ties, repeated rows, empty tables, further columns."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_contracts import base_spans, brute_passages, components_of, shingle_set

from tallyframe.llm import (
    decontaminate, graph, language, minhash, packing, pii, sharding, tokens, urls, vectors, warc,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, n_tokens string, row string, shard string, pii string"


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(5)
    long = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(40_000))
    rows = [
        (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "one", "en"), (5, "one", "en"),
        (5, "one", "en"), (6, long, "de"), (7, long + " tail", None), (8, "x" * 200_000, "de"),
        (9, "Ünïcödé 日本語 \u00a0\u2003 text <|endoftext|> it's 12.3", "fr"), (None, "null id here", "en"),
        (None, None, None), (10, "a@b.co 1.2.3.4 x 4111 1111 1111 1111 +1 (555) 555-1234", "en"),
    ]
    return spark.createDataFrame([(*r, "q", "w", "e", None) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pii(odd, empty):
    found = {r.doc_id: r for r in pii.summarise_pii(odd).collect() if r.doc_id}
    assert found[10].spans == "email:0:6,ip:7:14,card:17:36,phone:37:54"
    assert found[1].n_email == 0 and found[1].spans == ""
    assert pii.summarise_pii(empty).count() == pii.find_pii(empty).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask_pii(odd).collect()}
    assert masked[10] == "[EMAIL] [IP] x [CARD] [PHONE]" and masked[1] is None
    assert pii.mask_pii(odd).columns == odd.columns


def test_pii_context_and_account_numbers():
    text = "IBAN DE89 3704 0044 0532 0130 00 AND version 1.2.3.4"
    kinds = {k: (s, e, w) for k, s, e, w in pii.find(text)}
    assert text[kinds["iban"][0]:kinds["iban"][1]] == "DE89 3704 0044 0532 0130 00"
    assert kinds["iban"][2] > pii.WORTH["iban"] and kinds["ip"][2] < pii.WORTH["ip"]
    assert not [k for k, *_ in pii.find("DE88 3704 0044 0532 0130 00") if k == "iban"]


def test_pii_patterns_on_noise():
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choices("a.@-+ 1(0)2549%_é", k=60))
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == base_spans(text), text
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.find(text)


def test_token_counts(odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = {r.doc_id: r.text for r in odd.collect()}
    for chunk, overlap in ((tokens.CHUNK, tokens.OVERLAP), (500, 3)):
        ours = tokens.count_tokens(odd, BYTE_BPE, 1024, chunk=chunk, overlap=overlap).collect()
        for r in ours:
            if r.doc_id not in (None, 8) or chunk > 500:
                text = rows[r.doc_id] if r.doc_id else None
                if r.doc_id:
                    expected = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
                    assert (r.n_tokens, r.over_limit) == (expected, expected > 1024), r.doc_id
    assert tokens.count_tokens(empty, BYTE_BPE, 1024).count() == 0


def test_tokens_on_noise():
    from tokenizers import Tokenizer

    draw = random.Random(4)
    letters = "ab 'sé日\n\t \u00a0\u0085\x1c1,.<|>_²ßİ'tll\u0301"
    texts = ["".join(draw.choices(letters, k=80)) + draw.choice(["", "<|endoftext|>"]) for _ in range(1500)]
    whole = Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)
    for chunk in (20, 10_000):
        assert tokens.Counter(BYTE_BPE, chunk, 4)(texts) == [len(e.ids) for e in whole]
    whole = Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)
    made = tokens.WordIds(WORD_BPE)(texts)
    assert [np.frombuffer(m, "<u4").tolist() for m in made] == [e.ids for e in whole]


def test_packing(odd, empty):
    rows = packing.pack_documents(odd, WORD_BPE, 2, cell_tokens=20_000).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    assert all(r.doc_tokens == 1 for r in rows if r.doc_id in (1, 2, 3))
    assert packing.pack_documents(empty, WORD_BPE, 2).count() == 0


def test_windows_are_full():
    draw = random.Random(9)
    for _ in range(200):
        lengths = [draw.choice([0, 1, 5, 200, 300, 1024, 4096, 9000, draw.randint(0, 5000)]) for _ in range(draw.randint(0, 30))]
        windows = packing.pack(lengths)
        seen = sorted(p for w in windows for p in w)
        for text, length in enumerate(lengths):
            at = 0
            for _, start, size in [p for p in seen if p[0] == text]:
                assert start == at and size > 0
                at += size
            assert at == length
        for w in windows:
            total = sum(p[2] for p in w)
            assert total <= 4096 and total & (total - 1) == 0


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (2, "short item"),
    (3, None), (4, ""), (5, "..."), (None, "no name but words in this item, quite a few of them here"), (6, "a " * 40),
]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_passages(spark, empty, block):
    texts = [
        None, "", "SHORT item", "x " * 30 + ITEMS[0][1] + " y" * 9, ITEMS[0][1][:40], "a " * 25,
        "beta gamma delta epsilon zeta eta theta iota kappa lambda", ITEMS[6][1].upper(), "short-item", "shört item",
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(2, "SHORT item", "k")], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    ours = decontaminate.find_passages(docs, items, block_bytes=block).collect()
    expected = dict(brute_passages(enumerate(texts), [("" if i is None else i, t) for i, t in ITEMS]))
    assert len(ours) == len(texts) + 1
    for r in ours:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected[r.doc_id], r
    assert decontaminate.find_passages(empty, items, block_bytes=block).count() == 0
    assert not decontaminate.find_passages(docs, items.limit(0)).where("contaminated").count()


def test_winnowing_misses_nothing():
    draw = random.Random(8)
    for _ in range(300):
        words = [draw.choice("abcd") for _ in range(60)]
        start = draw.randint(0, 45)
        item = " ".join(["q"] * draw.randint(0, 9) + words[start:start + 14] + ["r"] * draw.randint(0, 9))
        text = " ".join(words)
        ours = decontaminate.Index([("1", item)], 10, 5).hits(text)
        expected = next(brute_passages([(0, text)], [(1, item)]))[1]
        assert (ours[0], decontaminate.covered(ours[1]), len(ours[2])) == expected[:3]


def test_language(odd, empty):
    network = language.train(odd, most_bytes=1 << 20, steps=20)
    assert language.train(odd, steps=2).languages == ["en", "fr"]  # longer texts are not sampled
    assert network.languages == ["de", "en", "fr"]
    found = {r.doc_id: r for r in language.identify(odd, network).collect()}
    assert all(found[d].lang_pred == "und" and found[d].score == 0 for d in (1, 2, 3))
    assert found[9].lang_pred in network.languages and 0 <= found[9].score <= 1
    assert language.train(empty) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.identify(empty, network).count() == 0
    assert len(language.label_positions(network, "straße")) == len("straße".encode())


def test_gradients_are_those_of_the_loss():
    network = language.Network(["a", "b"], hidden=3)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    words, labels = [b"abc", b"b", b"cab"], np.array([0, 1, 1])
    _, grads = network.gradients(words, labels)
    for name, at in (("ahead.gates", (4, 1)), ("back.candidate", (0, 2)), ("ahead.inputs", (97, 5)), ("back.gates", (0, 0)), ("out", (1, 4))):
        old, got = network.weights[name][at], []
        for step in (1e-3, -1e-3):
            network.weights[name][at] = old + step
            got.append(network.gradients(words, labels)[0])
        network.weights[name][at] = old
        assert abs((got[0] - got[1]) / 2e-3 - grads[name][at]) < 2e-3, name


def test_minhash(spark, odd, empty):
    found = {r.doc_id: r for r in minhash.near_duplicates(odd).collect() if r.doc_id}
    assert [found[d].n_shingles for d in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [found[d].component_id for d in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 4, 6, 6, 8]
    assert minhash.near_duplicates(odd).count() == odd.count()
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_group_near_the_threshold(spark):
    """Copies with many edits: some links hold and some do not, whichever the pivot."""
    draw = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(draw.choice([0, 1, 3, 5, 7])):
            words[draw.randrange(len(words))] = f"e{draw.random()}"
        rows.append((1000 - i, " ".join(words)))
    sets = {d: shingle_set(t, 3) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    expected = components_of(sets, links)
    assert len(set(expected.values())) > 3
    ours = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in ours} == expected


def test_sequential_test_keeps_similar_pairs():
    stops = minhash.least_agreements(0.85, 1e-6, 125, 25)
    assert [n for n, _ in stops] == [25, 50, 75, 100, 125]
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**32, (20_000, 125), np.uint32)
    same = draw.random(a.shape)
    assert len(minhash.survivors(a, np.where(same < 0.86, a, a + 1), stops)) >= 19_999
    assert len(minhash.survivors(a, np.where(same < 0.5, a, a + 1), stops)) == 0


def test_components(spark):
    draw = random.Random(6)
    links = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(90)]
    ours = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = components_of({i for pair in links for i in pair}, links)
    assert ours == {i: c for i, c in expected.items() if any(i in p and p[0] != p[1] for p in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, odd, empty):
    rows = sharding.shard_documents(odd, 4).collect()
    assert len(rows) == odd.count()
    counts = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard_documents(empty, 4).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]),
        (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]),
        (12, [1e-200, 0.0]), (13, [9.0, 4.35]), (14, [-1.0, 0.0]),
    ]
    table = spark.createDataFrame([(*r, "l") for r in rows], "vec_id long, embedding array<double>, n_links string")
    ours = {r.vec_id: r for r in vectors.near_vectors(table).collect() if r.vec_id}
    assert [ours[i].component_id for i in range(1, 15)] == [1, 1, 1, 4, 5, 6, 7, 8, 9, 10, 11, 1, 1, 14]
    assert ours[1].n_links == ours[2].n_links == 4 and ours[11].n_links == 0
    assert vectors.near_vectors(table.limit(0)).count() == 0
    assert vectors.near_vectors(table.where("vec_id = 7")).collect()[0].n_links == 0


def test_archive(spark, tmp_path):
    big = "é" * 60
    rows = [(1, "http://a/x", big), (2, None, big), (2, None, big), (3, "a\r\nb", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archive(pages, str(tmp_path / "a"))
    found = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert len(found) == len(rows)
    for r in found:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(rest) - 4
        assert rest[:-4] == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert (r.record_type == "revisit") == (bytes(r.payload) == big.encode() and r.page_id != 1)
        assert r.refers_to == (1 if r.record_type == "revisit" else None)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 3
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0


def test_damaged_archive_is_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    damaged = spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("digest", "cast('y' as binary) as payload").collect()
    spark.createDataFrame(damaged, "digest string, payload binary").write.mode("overwrite").parquet(str(tmp_path / "a/payloads"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, str(tmp_path / "a")).collect()


def test_urls(spark):
    model = urls.train(urls.labelled_table(spark))
    rows = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "HTTP://WWW.Example.COM/en/x?y#z"), (5, "x://net/es/"), (6, "x://a.net/fr"), (7, "x://" + "a" * 50_000), (7, "x://com?q://net/es/"), (8, "://é.com/")]
    table = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    found = urls.judge_urls(table, model).collect()
    by = {(r.page_id, r.path): r for r in found}
    assert len(found) == len(rows) and by[4, "/en/x"].host == "www.example.com"
    assert by[4, "/en/x"].rule == "www.example.com/en/" and by[4, "/en/x"].verdict == "allow"
    assert by[5, "/es/"].verdict == "block" and by[6, "/fr"].rule is None and by[8, "/"].rule == "com/"
    assert all(by[i, ""].host == "" and by[i, ""].rule is None for i in (1, 2, 3))
    assert urls.judge_urls(table.limit(0), model).count() == 0
    none = urls.train(spark.createDataFrame([], "url string, label int"))
    assert {r.verdict for r in urls.judge_urls(table, none).where("rule is null").collect()} == {"allow"}


def test_minhash_hot_bucket_of_unlinked_members(spark):
    """Most members are probes: no task holds more than two blocks, and any two rows of which one is a probe meet once."""
    draw = random.Random(12)
    rows, values = 300, 125
    sets = {i: np.unique(np.array([draw.getrandbits(63) for _ in range(60)], np.uint64)) for i in range(rows)}
    sets[250], sets[299] = sets[3], sets[8]  # the only links, between probes
    by = minhash.multipliers(values)
    component = {i: min(i, 40) if i < 60 else i for i in range(rows)}  # 40 to 59 are the largest one
    component |= {i: 40 for i in range(40, 60)}
    component[250], component[299] = 250, 299
    table = spark.createDataFrame([(i, sets[i].tobytes(), minhash.signature(sets[i], by).tobytes()) for i in sets], "id long, set binary, signature binary")
    buckets = spark.createDataFrame([(7, i) for i in sets], "bucket long, id long")
    joined = spark.createDataFrame([(i, component[i]) for i in range(40, 60)], "id long, component long")
    stops = minhash.least_agreements(0.85, 1e-6, values, 25)
    block_bytes = 20_000
    members = spark.createDataFrame([(7, i, component[i], not 40 <= i < 60) for i in sets], "bucket long, id long, component long, probe boolean")
    sizes = table.selectExpr("id", "octet_length(set) + 500 as bytes")
    held, met = {}, {}
    for r in minhash.block_pairs(members, sizes, block_bytes).collect():
        held.setdefault((r.low, r.high), []).append(r)
    for (low, high), some in held.items():
        assert sum(len(sets[r.id]) * 8 + 500 for r in some) < 2 * 1.5 * block_bytes
        left = [r.id for r in some if r.block == low]
        right = [r.id for r in some if r.block == high]
        pairs = [(a, b) for a in left for b in right]
        if some[0].within:
            pairs += [(a, b) for a in left for b in left if a < b]
        for a, b in pairs:
            met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    assert len(held) > 20
    assert met == {(a, b): 1 for a in sets for b in sets if a < b and not (40 <= a < 60 and 40 <= b < 60)}
    ours = minhash.rest_links(
        buckets, joined, table.select("id", "signature"), table.select("id", "set"), stops, 85, block_bytes
    ).collect()
    assert sorted((min(r), max(r)) for r in ours) == [(3, 250), (8, 299)]


def test_every_language_is_sampled(spark, empty):
    """More languages than 64, one only in long texts, one hidden behind other characters, one of equal rows."""
    rows = [(i, f"wort{i % 90} satz", f"l{i % 90:02}") for i in range(900)]
    rows += [(1000 + i, f"lang{i} " * 9000, "long") for i in range(3)]
    rows += [(2000, "1 2 " * 20_000 + "é", "late")] + [(3000, "same", "same")] * 500 + [(4000, "12 34", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.sample(docs, "text", "lang", "doc_id", 400, language.SAMPLE_BYTES, long_texts=True)
    assert set(found) == {f"l{i:02}" for i in range(90)} | {"long", "late", "same"}
    assert all(len(t.encode()) <= language.SAMPLE_BYTES and language.words_of(t) for some in found.values() for t in some)
    assert len(found["long"]) == 3 and sum(map(len, found.values())) <= language.SAMPLE_ROWS
    assert language.train(docs, steps=1, long_texts=True).languages == sorted(found)
    assert language.train(empty, long_texts=True) is None


def test_the_sample_is_bounded_over_all_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 100)
    rows = [(i, f"wort{i}", f"l{i % 40:02}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.sample(docs, "text", "lang", "doc_id", 400, language.SAMPLE_BYTES)
    assert len(found) == 40 and all(len(some) == 2 for some in found.values())


def test_urls_of_hosts_kept_out_of_training(spark):
    """Same words beside other parts, so every judged host is new to the model."""
    model = urls.train(urls.labelled_table(spark))
    part = spark.createDataFrame(urls.labelled_urls(), "url string, label int").select(urls.host_of(F.col("url")).alias("host"))
    others = spark.createDataFrame(urls.labelled_urls(held_out=True), "url string, page_id int")
    rows = urls.judge_urls(others, model, rules=()).join(part, "host", "left_anti").collect()
    blocked = [r.page_id for r in rows if r.verdict == "block"]
    assert len(rows) > 400 and sum(blocked) / len(blocked) >= 0.99
    assert len(blocked) / sum(r.page_id for r in rows) >= 0.99


def test_a_long_path_leaves_its_host_as_it_is(spark):
    model = urls.train(urls.labelled_table(spark))
    for host, verdict in (("best-poker-world.org", "block"), ("garden-letters.org", "allow")):
        rows = [(i, f"https://{host}/{path}") for i, path in enumerate(("", "a/b", "lorem/ipsum-dolor/" * 400))]
        found = urls.judge_urls(spark.createDataFrame(rows, "page_id int, url string"), model).collect()
        assert {r.verdict for r in found} == {verdict}


def test_one_id_that_holds_most_of_the_benchmark(spark):
    draw = random.Random(31)
    word = lambda: draw.choice("abcdefghijklmnop") * draw.randint(1, 3)
    shared = " ".join(f"shared{i}" for i in range(12))
    texts = [" ".join(word() for _ in range(30)) + " " + shared for _ in range(60)]
    items = [(7, t) for t in texts[:40]] + [(7, texts[0])] * 40 + [(None, t) for t in texts[40:]]
    docs = [(i, " ".join(texts[i].split()[3:25 + i])) for i in range(0, 60, 4)] + [(99, shared), (100, "x y z")]
    table = spark.createDataFrame(items, "item_id long, text string")
    ours = decontaminate.find_passages(
        spark.createDataFrame(docs, "doc_id long, text string"), table, block_bytes=2_000
    ).collect()
    expected = dict(brute_passages(docs, [("" if i is None else i, t) for i, t in items]))
    assert len(ours) == len(docs)
    for r in ours:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected[r.doc_id], r
    named = table.where("item_id = 7").selectExpr("cast(item_id as string) as item", "text").dropDuplicates()
    blocks = [decontaminate.block_of(named, b, 4) for b in range(4)]
    assert sum(map(len, blocks)) == 40 and max(map(len, blocks)) <= 20


def test_words_are_remembered_once_and_not_without_bound():
    """Memory of a packing task: no text twice, and all forgotten between batches when too many."""
    from tokenizers import Tokenizer

    made = tokens.WordIds(WORD_BPE)
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} Mixed{i}, caf\u00e9 \u6f22{i}" for i in range(200)]
    library = Tokenizer.from_file(WORD_BPE)
    wanted = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert made(texts) == wanted
    assert not set(made.pieces) & set(made.pieces.parts)
    made.pieces.most = 100
    for at in range(0, 200, 10):
        assert made(texts[at:at + 10]) == wanted[at:at + 10]
        assert len(made.pieces) + len(made.pieces.parts) <= 100
