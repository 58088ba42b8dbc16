"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads a word's bytes in both directions and labels every position
with a probability for each language.  It is trained in numpy by backpropagation
through time on the words of a bounded sample of labelled documents.  A
document's probabilities are the mean over all positions of all its words.  Words
are runs of ASCII letters, lower-cased, and of bytes from 0x80 on; other bytes
bound them and say nothing about a language.  Words recur, so a task labels each
distinct word once and remembers its sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.llm.common import map_texts
from tallyframe.sources.staging import staged

HIDDEN = 10
LONGEST = 24  # bytes of a sequence; longer words are read in parts of that length
SAMPLE_PER_LANGUAGE = 400
SAMPLE_ROWS = 6_400  # of all languages together
SAMPLE_BYTES = 20_000  # longer documents are left out, or stand with a window of their words
SAMPLE_WORDS = 4_000_000  # of all languages together
STEPS, BATCH, RATE = 500, 384, 0.01
REMEMBERED = 1_000_000
REMEMBERED_SUMS = 64_000_000  # words times languages
WORDS_AT_ONCE = 2048
UNDETERMINED = "und"

_LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_WORD_BYTES).split() if text else []


def encode(words: list[bytes], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Words as a (time, word) array of bytes, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), max(1, int(sizes.max(initial=0)))), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return np.ascontiguousarray(out.T), sizes


class Network:
    """Two gated recurrent layers, one per direction, and a softmax on both states.

    Per direction: ``inputs`` (256, 3H) for bytes, ``gates`` (2H, H) and
    ``candidate`` (H, H) for the state, ``bias`` within ``inputs``.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        self.languages, self.hidden = languages, hidden
        self.usual: dict[str, float] = {}
        draw = np.random.default_rng(seed)
        self.weights = {}
        for way in ("ahead", "back"):
            self.weights[f"{way}.inputs"] = draw.normal(0, 0.3, (256, 3 * hidden))
            self.weights[f"{way}.gates"] = draw.normal(0, hidden**-0.5, (2 * hidden, hidden))
            self.weights[f"{way}.candidate"] = draw.normal(0, hidden**-0.5, (hidden, hidden))
        self.weights["out"] = draw.normal(0, hidden**-0.5, (len(languages), 2 * hidden))
        self.weights["out_bias"] = np.zeros((len(languages), 1))
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def layer(self, way: str, x: np.ndarray, live: np.ndarray | None, trace: list | None = None):
        """States (time, H, word) of one direction.

        ``live`` marks the bytes of words of different lengths; outside them a
        word's state rests.
        """
        w, hidden = self.weights, self.hidden
        inputs, gates, candidate = w[f"{way}.inputs"], w[f"{way}.gates"], w[f"{way}.candidate"]
        times = range(len(x)) if way == "ahead" else range(len(x) - 1, -1, -1)
        h = np.zeros((hidden, x.shape[1]), np.float32)
        states = np.empty((len(x), hidden, x.shape[1]), np.float32)
        for t in times:
            given = inputs[x[t]].T
            zr = gates @ h
            zr += given[:2 * hidden]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:hidden], zr[hidden:]
            c = candidate @ (r * h)
            c += given[2 * hidden:]
            np.tanh(c, out=c)
            if trace is not None:
                trace.append((t, h, zr, c))
            step = c - h
            step *= z
            if live is not None:
                step *= live[t]
            h = h + step
            states[t] = h
        return states

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, language, word) probabilities for words of one length, (time, word) bytes."""
        w, half = self.weights, self.hidden
        p = w["out"][:, :half] @ self.layer("ahead", x, None)
        p += w["out"][:, half:] @ self.layer("back", x, None)
        p += w["out_bias"]
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def sums(self, words: list[bytes]) -> np.ndarray:
        """Per word: the sums of its positions' probabilities, (word, language)."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for i, word in enumerate(words):
            for at in range(0, len(word), LONGEST):
                part = word[at:at + LONGEST]
                by_length.setdefault(len(part), []).append((i, part))
        for length, parts in by_length.items():
            for at in range(0, len(parts), WORDS_AT_ONCE):
                some = parts[at:at + WORDS_AT_ONCE]
                flat = np.frombuffer(b"".join([w for _, w in some]), np.uint8)
                x = np.ascontiguousarray(flat.reshape(len(some), length).T)
                np.add.at(out, [i for i, _ in some], self.probabilities(x).sum(axis=0).T)
        return out

    def gradients(self, words: list[bytes], labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions, and its gradients through time."""
        x, sizes = encode(words)
        live = (np.arange(len(x))[:, None] < sizes).astype(np.float32)
        w, hidden, grads = self.weights, self.hidden, {}
        traces = {"ahead": [], "back": []}
        states = np.concatenate([self.layer(k, x, live, traces[k]) for k in traces], axis=1)
        p = np.exp(w["out"] @ states + w["out_bias"])
        p /= p.sum(axis=1, keepdims=True)
        count = live.sum()
        here = p[:, labels, np.arange(len(words))]
        loss = float(-(np.log(here + 1e-12) * live).sum() / count)
        p[:, labels, np.arange(len(words))] -= 1
        p *= (live / count)[:, None]
        grads["out"] = np.einsum("tcb,thb->ch", p, states)
        grads["out_bias"] = p.sum(axis=(0, 2))[:, None]
        d_states = np.einsum("ch,tcb->thb", w["out"], p)
        for number, way in enumerate(traces):
            gates, candidate = w[f"{way}.gates"], w[f"{way}.candidate"]
            d_inputs = np.zeros((256, 3 * hidden), np.float32)
            d_gates, d_candidate = np.zeros_like(gates), np.zeros_like(candidate)
            dh = np.zeros((hidden, len(words)), np.float32)
            for t, before, zr, c in reversed(traces[way]):
                dh = dh + d_states[t, number * hidden:(number + 1) * hidden]
                z, r = zr[:hidden], zr[hidden:]
                moved = z * live[t]
                dc = dh * moved * (1 - c * c)
                dz = dh * (c - before) * live[t] * z * (1 - z)
                drh = candidate.T @ dc
                dr = drh * before * r * (1 - r)
                d_zr = np.concatenate([dz, dr])
                d_candidate += dc @ (r * before).T
                d_gates += d_zr @ before.T
                np.add.at(d_inputs, x[t], np.concatenate([d_zr, dc]).T)
                dh = dh * (1 - moved) + drh * r + gates.T @ d_zr
            grads |= {f"{way}.inputs": d_inputs, f"{way}.gates": d_gates, f"{way}.candidate": d_candidate}
        return loss, grads

    def train(self, words: list[list[bytes]], steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam on batches that hold words of every language equally often."""
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        each = max(8, BATCH // len(words))
        labels = np.repeat(np.arange(len(words)), each)
        for step in range(1, steps + 1):
            batch = [some[i] for some in words for i in draw.integers(0, len(some), each)]
            loss, grads = self.gradients(batch, labels)
            losses.append(loss)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                scale = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
                self.weights[k] -= (rate * first[k] / (1 - 0.9**step) / scale).astype(np.float32)
        return losses


def sample(
    docs: DataFrame, text: str, lang: str, key: str, per_language: int, most_bytes: int,
    long_texts: bool = False,
) -> dict[str, list[str]]:
    """Texts by language: at most so many each, those that a hash of the row puts first.

    Every language has its part of ``SAMPLE_ROWS``, one row at least.  Longer
    texts are left out or, with ``long_texts``, stand with a window of their words
    that is drawn by the hash, so that no language with a letter is missed.  Rows are taken
    below a share of the hash range that more rows reach than are wanted, and the
    first row of a language always, so that one scan finds all samples.
    """
    labelled = docs.select(
        docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"),
        F.xxhash64(docs[key].cast("string"), docs[text]).alias("order"),
    ).where("lang is not null and text is not null")
    if long_texts:
        labelled = labelled.where(F.col("text").rlike(_LETTER))
    else:
        labelled = labelled.where(F.octet_length("text") <= most_bytes)
    counts = staged(
        labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("least")), "languages"
    )
    languages = counts.count()
    if not languages:
        return {}
    per_language = min(per_language, max(1, SAMPLE_ROWS // languages))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 20) / F.col("n"))
    below = F.when(share < 1, (F.lit(float(2**63)) * (2 * share - 1)).cast("long")).otherwise(F.lit(2**63 - 1))
    found = labelled.join(
        counts.select("lang", F.greatest("least", below).alias("below")), "lang"
    ).where("order <= below")
    if long_texts:
        # Without runs of other characters every window of two characters has a letter.
        dense = F.regexp_replace("text", f"(?:(?!{_LETTER})[\\s\\S])+", " ")
        wide = max(2, most_bytes // 4)
        start = F.pmod("order", F.greatest(F.lit(1), F.length("dense") - wide + 1)).cast("int") + 1
        found = found.withColumn("dense", F.when(F.octet_length("text") > most_bytes, dense)).withColumn(
            "text", F.coalesce(F.col("dense").substr(start, F.lit(wide)), "text")
        )
    first = Window.partitionBy("lang").orderBy("order", "text")
    rows = (
        found.select("lang", "text", "order", F.row_number().over(first).alias("place"))
        .where(F.col("place") <= per_language).orderBy("lang", "place").toLocalIterator()
    )
    out: dict[str, list[str]] = {}
    for row in rows:
        out.setdefault(row.lang, []).append(row.text)
    return out


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    per_language: int = SAMPLE_PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES, steps: int = STEPS,
    long_texts: bool = False, kept_out: int = 0,
) -> Network | None:
    """A network fitted on a bounded sample of the labelled rows; none without such rows.

    With ``long_texts`` every language that labels a letter is learned.  With
    ``kept_out`` every so manieth text of a language's sample is not trained on:
    ``usual`` is the median score of these texts for their own language (of the
    whole sample where it is smaller than twice that number).
    """
    texts = sample(docs, text, lang, key, per_language, most_bytes, long_texts)
    judged = {}
    if kept_out:
        for language, some in texts.items():
            judged[language] = some[::kept_out] if len(some) >= 2 * kept_out else some
            if len(some) >= 2 * kept_out:
                texts[language] = [t for i, t in enumerate(some) if i % kept_out]
    words, most, draw = {}, max(20_000, SAMPLE_WORDS // max(1, len(texts))), np.random.default_rng(5)
    for language, some in texts.items():
        parts = [w[:LONGEST] for t in some for w in words_of(t)]
        if len(parts) > most:
            parts = [parts[i] for i in draw.choice(len(parts), most, replace=False)]
        if parts:
            words[language] = parts
    if not words:
        return None
    network = Network(sorted(words))
    network.train([words[k] for k in network.languages], steps)
    identifier = Identifier(network)
    for place, language in enumerate(network.languages if judged else ()):
        network.usual[language] = float(np.median(identifier.pooled(judged[language])[:, place]))
    return network


class Identifier:
    """Pooled probabilities of texts, with the sums of known words remembered."""

    def __init__(self, network: Network):
        self.network, self.rows = network, {}
        self.table = np.zeros((0, len(network.languages)), np.float32)
        self.most = min(REMEMBERED, REMEMBERED_SUMS // len(network.languages))

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        needed = set().union(*words)
        new = list(needed.difference(self.rows))
        if len(self.rows) + len(new) > self.most:
            self.rows, self.table, new = {}, self.table[:0], list(needed)
        if new:
            self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, self.network.sums(new)])
        out = np.zeros((len(texts), len(self.network.languages)))
        for i, some in enumerate(words):
            if some:
                at = np.fromiter(map(self.rows.__getitem__, some), np.int64, len(some))
                total = self.table[at].sum(axis=0, dtype=np.float64)
                out[i] = total / total.sum()
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        pooled = self.pooled(texts)
        best = pooled.argmax(axis=1)
        names, scores = [], []
        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):  # a letter is a byte of some word
                names.append(self.network.languages[best[i]])
                scores.append(min(1.0, float(pooled[i, best[i]])))
            else:
                names.append(UNDETERMINED)
                scores.append(0.0)
        return names, scores


def identify(
    docs: DataFrame, network: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Append ``lang_pred`` and ``score`` (the pooled probability of that language).

    A text that is null or holds no letter is ``und`` with score 0; so is every
    text if there was nothing to learn from.
    """
    if network is None:
        return docs.select(
            *keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    held = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        identifier = Identifier(held.value)
        return lambda texts: identifier(texts)

    return map_texts(docs, text, make, "lang_pred string, score double", list(keep))


def label_positions(network: Network, word: str) -> list[str]:
    """The language of every byte of one word."""
    out, data = [], word.encode().lower()
    for at in range(0, len(data), LONGEST):
        x = np.frombuffer(data[at:at + LONGEST], np.uint8)[:, None]
        out += [network.languages[i] for i in network.probabilities(x)[:, :, 0].argmax(axis=1)]
    return out
