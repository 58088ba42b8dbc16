"""Token ids and counts with the files of public tokenizers.

``Counter`` counts the tokens of a byte-level BPE.  A boundary between a
character that is not white space and an ASCII white-space character is a
proven cut: no alternative of the pre-tokenizer's pattern holds white space
after another character, matching proceeds from the cut on without regard to
what precedes it, and the special tokens hold no white space.  So

* ordinary texts are cut at all such places and the pieces, of which most occur
  again and again, are encoded once per task;
* huge texts are encoded in overlapping chunks with offsets.  Neighbouring
  chunks are spliced at a proven cut inside the overlap where both have a token
  end; where there is none, the overlap is doubled, up to the whole text.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import map_texts

CHUNK = 32_768
OVERLAP = 256
REMEMBERED = 1_000_000
REMEMBERED_WORDS = 600_000

# White space other than space, tab, line feed and carriage return (fixed values).
_RARE_SPACE = re.compile(
    r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
_PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_CUT = re.compile(r"(?<=[^\W_])(?=[ \n\t\r])")
_BLANK_CUT = re.compile(r"[^ \n\t\r]+")

# Characters on which the patterns below equal those of the tokenizer files.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_COMMON = re.compile(f"[ \t\n\r!-~{_LETTERS}]+")
_BYTE_LEVEL = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t\n\r{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+"
)
_WORD_LEVEL = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^ \t\n\r{_LETTERS}0-9]+")
# Byte-level vocabularies name printable bytes by themselves and the others, in
# order, by the characters from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_NAMES = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)
}
_SPACES = {ord(c): BYTE_NAMES[ord(c)] for c in " \t\n\r"}


def tokenizer(path: str):
    """The library's tokenizer, on one thread, with special strings as by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class Pieces(dict):
    """Ids (little-endian 32-bit) of short pieces of text by the library, remembered.

    A piece of ASCII and Latin-1 letters alone is cut by ``pattern``, which equals
    the file's pre-tokenizer on these characters, and each part goes to the
    library's model; any other piece goes through the whole library.
    """

    def __init__(self, path: str, pattern: re.Pattern, lower: bool):
        super().__init__()
        self.encoder, self.split, self.lower = tokenizer(path), pattern.findall, lower
        self.tokenize, self.parts = self.encoder.model.tokenize, {}

    def __missing__(self, piece: str) -> bytes:
        if _COMMON.fullmatch(piece) and "<|" not in piece:
            ids, parts = b"", self.parts
            for part in self.split(piece.lower() if self.lower else piece):
                made = parts.get(part)
                if made is None:
                    mapped = (
                        part.translate(_SPACES) if part.isascii()
                        else "".join(map(BYTE_NAMES.__getitem__, part.encode()))
                    )
                    made = parts[part] = packed([t.id for t in self.tokenize(mapped)])
                ids += made
        else:
            ids = packed(self.encoder.encode(piece, add_special_tokens=False).ids)
        self[piece] = ids
        return ids

    def forget(self) -> None:
        """Start anew when too much is held; called between batches."""
        if len(self) > REMEMBERED:
            self.clear()
            self.parts.clear()


class LeanPieces(Pieces):
    """Pieces whose parts are remembered among them, each text once and ``most`` between batches."""

    def __init__(self, path: str, pattern: re.Pattern, lower: bool, most: int):
        super().__init__(path, pattern, lower)
        self.most = most

    def __missing__(self, piece: str) -> bytes:
        if not _COMMON.fullmatch(piece) or "<|" in piece:
            ids = packed(self.encoder.encode(piece, add_special_tokens=False).ids)
        else:
            parts = self.split(piece.lower())
            if len(parts) > 1 or parts[0] != piece:
                ids = b"".join(map(self.__getitem__, parts))
            else:
                mapped = piece if piece.isascii() else "".join(map(BYTE_NAMES.__getitem__, piece.encode()))
                ids = packed([t.id for t in self.tokenize(mapped)])
        self[piece] = ids
        return ids

    def forget(self) -> None:
        if len(self) > self.most:
            self.clear()


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Counter:
    """Token counts of texts, with pieces remembered between them."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.pieces = Pieces(path, _BYTE_LEVEL, lower=False)
        self.encoder, self.chunk, self.overlap = self.pieces.encoder, chunk, max(1, overlap)

    def __call__(self, texts: list[str | None]) -> list[int]:
        counts, cut = [0] * len(texts), {}
        for row, text in enumerate(texts):
            if not text:
                continue
            if len(text) > self.chunk:
                counts[row] = self.spliced(text)
            elif _RARE_SPACE.search(text):
                counts[row] = len(self.encoder.encode(text, add_special_tokens=False))
            else:
                cut[row] = _PIECE.findall(text)
        for row, pieces in cut.items():
            counts[row] = len(b"".join(map(self.pieces.__getitem__, pieces))) // 4
        self.pieces.forget()
        return counts

    def ends(self, text: str, start: int, stop: int) -> np.ndarray:
        """Where the tokens of a chunk end, in the whole text."""
        offsets = self.encoder.encode(text[start:stop], add_special_tokens=False).offsets
        return np.fromiter((end for _, end in offsets), np.int64, len(offsets)) + start

    def spliced(self, text: str) -> int:
        """The count of a huge text from overlapping chunks."""
        total = done = 0  # ``done`` is a proven cut; tokens that end up to it are counted
        stop = min(len(text), self.chunk)
        ends = self.ends(text, 0, stop)
        while stop < len(text):
            overlap = self.overlap
            while True:
                begin = max(done, stop - overlap)
                until = min(len(text), max(begin + self.chunk, stop + overlap))
                following = self.ends(text, begin, until)
                at = self.common(text, ends, following, begin, stop)
                if at is not None:
                    total += int(
                        np.searchsorted(ends, at, "right") - np.searchsorted(ends, done, "right")
                    )
                    done = at
                    break
                if begin == done:  # a longer chunk from the last cut on takes this one's place
                    break
                overlap *= 2
            ends, stop = following, until
        return total + int(len(ends) - np.searchsorted(ends, done, "right"))

    @staticmethod
    def common(text, ends, following, low, high) -> int | None:
        """The last proven cut in (low, high) at which both encodings end a token."""
        for cut in reversed([m.start() for m in _CUT.finditer(text, low, high)]):
            if low < cut < high and all(
                i < len(e) and e[i] == cut
                for e in (ends, following) for i in [np.searchsorted(e, cut)]
            ):
                return cut
        return None


def count_tokens(
    docs: DataFrame, path: str, limit: int, column: str = "text",
    keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit``; a null text counts as empty."""

    def make():
        counter = Counter(path, chunk, overlap)
        return lambda texts: [
            [len(t.encode()) if t else 0 for t in texts], counter(texts),
        ]

    counted = map_texts(docs, column, make, "n_bytes bigint, n_tokens bigint", list(keep))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


class WordIds:
    """Token ids of texts as little-endian 32-bit words, for a tokenizer that drops white space.

    Its tokens never hold white space, its normaliser works on single characters
    (NFC never composes with a space), so a text's ids are those of its words.
    """

    def __init__(self, path: str, end_id: int | None = None, most: int = REMEMBERED_WORDS):
        self.pieces = LeanPieces(path, _WORD_LEVEL, lower=True, most=most)
        self.end = b"" if end_id is None else packed([end_id])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        words = [
            [] if not t else _BLANK_CUT.findall(t) if _RARE_SPACE.search(t) else t.split()
            for t in texts
        ]
        ids = [b"".join(map(self.pieces.__getitem__, ws)) + self.end for ws in words]
        self.pieces.forget()
        return ids
