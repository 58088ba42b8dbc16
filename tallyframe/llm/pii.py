"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Four base kinds (email, ip, card, phone) follow fixed patterns; ``iban`` is
proposed by its shape and confirmed by the remainder mod 97.  Every span has a
score: what its pattern and checksum are worth, raised or lowered by words in
the ``CONTEXT`` characters before it.  All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from tallyframe.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
CONTEXT = 40
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8}
HINTS = {
    "email": ("mail", "e-mail", "email", "contact", "contacto", "kontakt", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse", "login"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
AGAINST = {
    "ip": ("version", "release", "section", "v"),
    "card": ("order", "isbn", "serial", "invoice"),
    "phone": ("isbn", "order", "version"),
}
HINT_WORTH, AGAINST_WORTH = 0.15, 0.25

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The quantified classes exclude what follows them, so giving characters back can
# never help a match; the possessive form only avoids quadratic retries.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number, without spaces, leaves 1 modulo 97."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, found from each @ outwards."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [
        m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15
    ]


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers; where further capitals follow, the longest part that checks counts."""
    found = []
    for m in _IBAN.finditer(text):
        part = m[0]
        while part:
            plain = part.replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                found.append((m.start(), m.start() + len(part)))
                break
            part = part.rpartition(" ")[0]
    return found


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans}


def score(kind: str, text: str, start: int) -> float:
    """The worth of the pattern and checksum, adjusted by the words just before the span."""
    words = set(_WORD.findall(text[max(0, start - CONTEXT):start].lower()))
    worth = WORTH[kind]
    if words.intersection(HINTS[kind]):
        worth += HINT_WORTH
    if words.intersection(AGAINST.get(kind, ())):
        worth -= AGAINST_WORTH
    return round(min(1.0, max(0.0, worth)), 2)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score), by kind as listed and then by start."""
    if not text:
        return []
    return [
        (kind, start, end, score(kind, text, start))
        for kind in KINDS for start, end in FINDERS[kind](text)
    ]


def mask(text: str | None, spans: list, least: float = 0.0) -> str | None:
    """The text with each span of at least that score replaced by its kind.

    Overlapping spans are replaced together, named after the first.
    """
    if not text or not spans:
        return text
    out, done, name, stop = [], 0, None, 0
    for start, end, kind in sorted((s, e, k) for k, s, e, worth in spans if worth >= least):
        if name is not None and start < stop:
            stop = max(stop, end)
            continue
        if name is not None:
            out.append(f"[{name.upper()}]")
            done = stop
        out.append(text[done:start])
        name, stop = kind, end
    if name is None:
        return text
    return "".join([*out, f"[{name.upper()}]", text[stop:]])


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)


def find_pii(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append ``pii``: an array of (kind, start, end, score, found) per row.

    Positions are code points, the end is exclusive.  A null or empty text has
    no spans.  Rows are independent, so repeated rows give repeated results.
    """

    def work(texts):
        return [[
            [(k, s, e, worth, t[s:e]) for k, s, e, worth in find(t)] for t in texts
        ]]

    return map_texts(
        docs, column, lambda: work,
        "pii array<struct<kind:string,start:bigint,end:bigint,score:double,found:string>>",
        list(keep),
    )


def summarise_pii(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans, and their scores."""

    def work(texts):
        found = [find(t) for t in texts]
        base = [[s for s in spans if s[0] in BASE] for spans in found]
        counts = [[sum(s[0] == kind for s in spans) for spans in base] for kind in BASE]
        return [
            *counts,
            [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base],
            [joined(spans) for spans in found],
            [",".join(str(s[3]) for s in spans) for spans in found],
        ]

    return map_texts(
        docs, column, lambda: work,
        ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string, scores string",
        list(keep),
    )


def mask_pii(docs: DataFrame, column: str = "text", least: float = 0.5) -> DataFrame:
    """The table with the spans of ``column`` masked; other columns and nulls stay as they are."""
    others = [c for c in docs.columns if c != column]

    def work(texts):
        return [[mask(t, find(t), least) for t in texts]]

    return map_texts(docs, column, lambda: work, f"`{column}` string", others).select(*docs.columns)
