"""Each query against a plain brute-force version on whole small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallyframe.llm import queries, sharding, urls, vectors, warc
from tallyframe.llm.queries import QUERIES
from tallyframe.sources.files import load


@pytest.fixture(scope="module")
def documents(spark, data_dir):
    return load(spark, data_dir, "documents").toPandas()


def run(spark, data_dir, name):
    return QUERIES[name](spark, data_dir).toPandas()


def components_of(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {i: find(i) for i in ids}


def test_op1_archive(spark, data_dir):
    pages = load(spark, data_dir, "pages").toPandas()
    ours = run(spark, data_dir, "op1_warc").set_index("page_id")
    assert len(ours) == len(pages)
    first = {}
    for page, html in sorted(zip(pages.page_id, pages.html.fillna(""))):
        first.setdefault(html, page)
    for page, html in zip(pages.page_id, pages.html.fillna("")):
        data = html.encode()
        revisit = len(data) >= 100 and first[html] != page
        row = ours.loc[page]
        assert row.payload_bytes == len(data)
        assert row.payload_digest == hashlib.sha256(data).hexdigest()
        assert row.record_type == ("revisit" if revisit else "response")
        assert (row.refers_to == first[html]) if revisit else (row.refers_to != row.refers_to)


def test_op1_rebuilds_every_record(spark, data_dir):
    """Whole records, put together here from the pages alone."""
    pages = load(spark, data_dir, "pages").toPandas()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a payload table of any size
    try:
        result = queries.op1_warc(spark, data_dir)
        plan = result._jdf.queryExecution().executedPlan().toString()
        ours = result.toPandas().set_index("page_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Only headers are shuffled for the join; payloads lie in their buckets.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    first = {}
    for page, html in sorted(zip(pages.page_id, pages.html.fillna(""))):
        first.setdefault(html, page)
    for page, url, html in zip(pages.page_id, pages.url, pages.html.fillna("")):
        data = html.encode()
        revisit = len(data) >= 100 and first[html] != page
        fields = [
            ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page}>"),
            ("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(data).hexdigest()),
            ("WARC-Profile", warc.REVISIT if revisit else None),
            ("WARC-Refers-To", f"<urn:page:{first[html]}>" if revisit else None),
            ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", 0 if revisit else len(data)),
        ]
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
        record = head.encode() + (b"" if revisit else data) + b"\r\n\r\n"
        assert ours.loc[page].record_bytes == len(record)
        assert ours.loc[page].record_sha256 == hashlib.sha256(record).hexdigest()


def test_op2_urls(spark, data_dir):
    pages = load(spark, data_dir, "pages").toPandas().set_index("page_id")
    ours = run(spark, data_dir, "op2_urls")
    assert len(ours) == len(pages)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"),
             ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    for row in ours.itertuples():
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", pages.url[row.page_id]).groups()
        assert (row.host, row.path) == (host.lower(), path)
        fit = [r for r in rules if ("." + host).endswith("." + r[1]) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        assert row.rule == (best and best[1] + best[2])
        assert row.verdict == (best[0] if best else "block" if row.score >= urls.BLOCK_FROM else "allow")
    unwanted = ours[ours.rule.isna() & ours.host.str.contains("spam-farm|casino-win|cheap-pills")]
    assert (unwanted.verdict == "block").all()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def luhn(digits):
        total = 0
        for i, d in enumerate(reversed(digits)):
            d = int(d) * (1 + i % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            holds = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if holds:
                out.append((kind, *m.span()))
    return out


def test_op3_pii(spark, data_dir, documents):
    ours = run(spark, data_dir, "op3_pii").set_index("doc_id")
    assert len(ours) == len(documents)
    seen = 0
    for doc, text in zip(documents.doc_id, documents.text.fillna("")):
        spans = base_spans(text)
        seen += len(spans)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        row = ours.loc[doc]
        assert [row[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(row.spans.split(","))
    assert seen


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def test_op4_minhash(spark, data_dir, documents):
    ours = run(spark, data_dir, "op4_minhash").set_index("doc_id")
    sets = {d: shingle_set(t, 3) for d, t in zip(documents.doc_id, documents.text)}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    expected = components_of(sets, links)
    assert links and len(ours) == len(sets)
    for d in sets:
        row = ours.loc[d]
        assert (row.n_shingles, row.component_id, row.kept) == (
            len(sets[d]), expected[d], expected[d] == d
        )


def test_op5_language(spark, data_dir, documents):
    ours = run(spark, data_dir, "op5_language").set_index("doc_id")
    langs = documents.set_index("doc_id").lang
    assert len(ours) == len(langs)
    for d in langs.index:
        assert ours.held_out[d] == (zlib.crc32(str(d).encode()) % 4 == 2)
    assert ours.score.between(0, 1).all()
    held = ours[ours.held_out]
    right = (held.lang_pred == langs[held.index]).mean()
    assert right > 0.9, right


def test_op6_tokens(spark, data_dir, documents):
    from tokenizers import Tokenizer

    ours = run(spark, data_dir, "op6_tokens").set_index("doc_id")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = documents.text.fillna("").tolist()
    for d, text, made in zip(
        documents.doc_id, texts, tokenizer.encode_batch(texts, add_special_tokens=False)
    ):
        assert (ours.n_bytes[d], ours.n_tokens[d]) == (len(text.encode()), len(made.ids))
        assert ours.over_limit[d] == (len(made.ids) > 1024)


def brute_links(table, least):
    able = {
        r.vec_id: np.asarray(r.embedding, float) for r in table.itertuples()
        if r.embedding is not None and np.isfinite(np.asarray(r.embedding, float)).all()
        and np.asarray(r.embedding, float).any()
    }
    links = []
    ids = sorted(able)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = able[a], able[b]
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links.append((a, b))
    return links


def assert_vectors(ours, table, least):
    links = brute_links(table, least)
    expected = components_of(table.vec_id, links)
    count = collections.Counter(i for pair in links for i in pair)
    ours = ours.set_index("vec_id")
    assert len(ours) == len(table)
    for i in table.vec_id:
        row = ours.loc[i]
        assert (row.n_links, row.component_id, row.kept) == (count[i], expected[i], expected[i] == i)
    return len(links)


def test_op7_vectors(spark, data_dir):
    table = load(spark, data_dir, "embeddings").toPandas()
    assert_vectors(run(spark, data_dir, "op7_vectors"), table, 0.9)


def test_vectors_over_many_tiles(spark, data_dir):
    embeddings = load(spark, data_dir, "embeddings")
    ours = vectors.near_vectors(embeddings, least=0.3, tile=40).toPandas()
    assert assert_vectors(ours, embeddings.toPandas(), 0.3)


def test_vectors_exactly_at_the_threshold(spark):
    """Whole-number pairs of cosine exactly 0.9, among others; lengths do not matter."""
    rng = np.random.default_rng(9)
    bases = [(10, 0, 0, 0, 0, 0), (9, 3, 3, 1, 0, 0), (9, 0, 0, 1, 3, 3), (0, 0, 10, 0, 0, 0), (1, 1, 9, 0, 1, 4)]
    rows = [
        (i, [float(v) * [1.0, 4.0, 0.5][i % 3] for v in rng.permutation(bases[i % 5])])
        for i in range(300)
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = np.array([r[1] for r in rows])
    squares = (whole**2).sum(axis=1)
    near = whole @ whole.T / np.sqrt(np.outer(squares, squares)) >= 0.9
    np.fill_diagonal(near, False)
    exact = np.isclose(whole @ whole.T / np.sqrt(np.outer(squares, squares)), 0.9, atol=1e-13)
    assert exact.sum() > 100
    expected = components_of(range(300), np.argwhere(near).tolist())
    for tile in (4096, 32):
        ours = vectors.near_vectors(table, tile=tile).toPandas().set_index("vec_id")
        assert [ours.n_links[i] for i in range(300)] == near.sum(axis=1).tolist()
        assert ours.component_id.to_dict() == expected


def test_op8_sharding(spark, data_dir, documents):
    ours = run(spark, data_dir, "op8_sharding").set_index("doc_id")
    assert len(ours) == len(documents) and (ours.law == "rows").all()
    counts = ours.shard.value_counts().reindex(range(24), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, slots in ours.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    for d, text in zip(documents.doc_id, documents.text.fillna("")):
        data = text.encode()
        assert (ours["size"][d], ours.text_crc32[d]) == (len(data) + 8, zlib.crc32(data))
    # Copies stay together unless quotas forbid it.
    shards = ours.shard[documents.doc_id].groupby(documents.text.values).nunique()
    copies = documents.text.value_counts()
    assert (shards[copies[copies > 1].index] == 1).mean() > 0.9


def test_op9_packing(spark, data_dir, documents):
    from tokenizers import Tokenizer

    ours = run(spark, data_dir, "op9_packing")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = documents.text.fillna("").tolist()
    made = tokenizer.encode_batch(texts, add_special_tokens=False)
    ids = {d: np.array([*e.ids, 2], "<u4") for d, e in zip(documents.doc_id, made)}
    pieces = collections.defaultdict(list)
    for row in ours.itertuples():
        whole = ids[row.doc_id]
        assert row.doc_tokens == len(whole) and row.length > 0
        assert row.ids_crc32 == zlib.crc32(whole[row.start:row.start + row.length].tobytes())
        pieces[row.doc_id].append((row.start, row.length))
    for d, whole in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == len(whole)
    for _, some in ours.groupby("sequence_id"):
        some = some.sort_values("offset")
        assert (some.offset.values == np.concatenate([[0], some.length.cumsum()[:-1]])).all()
        total = some.length.sum()
        assert total <= 4096 and total & (total - 1) == 0  # full at a power of two


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_passages(documents, benchmark, window=10):
    windows = collections.defaultdict(set)
    for item, text in benchmark:
        words = words10(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i:i + size])].add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text in documents:
        words, hit, items = words10(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                found = windows.get(tuple(words[i:i + size]))
                if found:
                    hit.update(range(i, i + size))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        yield doc, (len(words), len(hit), len(items), digest, bool(hit))


def test_op10_decontaminate(spark, data_dir, documents):
    benchmark = load(spark, data_dir, "benchmark").toPandas()
    ours = run(spark, data_dir, "op10_decontaminate").set_index("doc_id")
    expected = dict(brute_passages(
        zip(documents.doc_id, documents.text), zip(benchmark.item_id, benchmark.text)
    ))
    assert len(ours) == len(expected) and ours.contaminated.any()
    for doc, row in expected.items():
        assert tuple(ours.loc[doc, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]]) == row


def test_cut_links(spark):
    rows = spark.createDataFrame(
        [(i, "g" if i < 300 else f"s{i // 2}" if i < 400 else None) for i in range(900)],
        "row long, group string",
    )
    made = sharding.balanced_shards(rows, 6).cache()
    counts = made.groupBy("shard").count().toPandas()["count"]
    assert counts.max() - counts.min() <= 1 and counts.sum() == 900
    cut = {r.group: r.outside for r in sharding.cut_links(made).collect()}
    assert cut["g"] <= 160 and sum(v for k, v in cut.items() if k != "g") <= 10


