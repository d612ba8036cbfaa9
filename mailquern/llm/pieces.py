"""Texts above a size limit cut into overlapping pieces at natural boundaries.

Sizes are tokens of a public tokenizer. A text is split by the first kind of
boundary that it has: sections, paragraphs, lines, sentences, words and at last
characters; a part that is still too large is split by the next kind. The parts
are then packed into pieces, each as full as the limit lets it be, and each
piece but the first starts with the last tokens of the one before.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Encoder, encoder, vocabulary

#: Where a part ends, from the coarsest kind to the finest; after these come characters.
LEVELS = tuple(
    re.compile(p)
    for p in (
        r"(?:\r\n|\n|\r)+(?=#{1,6} |[-=_*]{3,}[ \t]*(?:\r|\n))",
        r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+",
        r"\r\n|\n|\r|\u2028|\u2029",
        r"[.!?\u2026\u3002]+[\"'\u201d\u2019\u00bb)\]]*[ \t\u00a0]+",
        r"\s+",
    )
)


class Sizes:
    """Token counts between byte places of one text, and its character places in bytes."""

    def __init__(self, enc: Encoder, text: str, ids: np.ndarray) -> None:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self.char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        self.ends = np.cumsum(enc.width[ids], dtype=np.int64)

    def before(self, chars: np.ndarray) -> np.ndarray:
        """Tokens that start before each character place."""
        return np.searchsorted(self.ends, self.char[chars], side="left")

    def tail(self, end: int, tokens: int) -> int:
        """The character place from which at least ``tokens`` tokens reach to ``end``."""
        k = int(np.searchsorted(self.ends, self.char[end], side="left")) - tokens
        byte = self.ends[k - 1] if k > 0 else 0
        return int(np.searchsorted(self.char, byte, side="right")) - 1


def _parts(text: str, sizes: Sizes, most: int, start: int = 0, end: int | None = None, cuts: list[np.ndarray | None] | None = None) -> list[int]:
    """The ends of the parts, none of more than ``most`` tokens as counted within the whole text."""
    cuts = [None] * len(LEVELS) if cuts is None else cuts
    out: list[int] = []
    stack = [(start, len(text) if end is None else end, 0)]
    n = lambda a, b: int(np.diff(sizes.before(np.array([a, b])))[0])
    while stack:
        a, b, level = stack.pop()
        if n(a, b) <= most or b - a == 1:
            out.append(b)
            continue
        while level < len(LEVELS):
            if cuts[level] is None:
                cuts[level] = np.fromiter((m.end() for m in LEVELS[level].finditer(text)), np.int64)
            c = cuts[level]
            own = c[np.searchsorted(c, a, side="right") : np.searchsorted(c, b, side="left")]
            level += 1
            if len(own):
                break
        else:
            at = sizes.before(np.arange(a, b + 1))
            own, k, step = [], a, max(1, most // 32)  # small parts, so that pieces of unbroken text fill up
            while at[-1] - at[k - a] > step:
                k = max(k + 1, a + int(np.searchsorted(at, at[k - a] + step, side="right")) - 1)
                own.append(k)
        edges = [a, *map(int, own), b]
        stack += [(x, y, level) for x, y in reversed(list(zip(edges, edges[1:])))]
    return out


def split_text(enc: Encoder, text: str, limit: int = 1024, overlap: int = 64) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece of a text, in characters; one piece if it is within the limit.

    A part that fits a piece beside the overlap is never cut. Counting a piece
    by itself may give other tokens at its edges than the whole text has there,
    so each piece is encoded and gives up parts until it fits; a single part
    that doesn't is split at its next finer boundary.
    """
    if not text:
        return []
    count = lambda a, b: len(enc.encode(text[a:b])) // 4
    ids = np.frombuffer(enc.encode(text), np.int32)
    if len(ids) <= limit:
        return [(0, len(text), len(ids))]
    sizes = Sizes(enc, text, ids)
    cuts: list[np.ndarray | None] = [None] * len(LEVELS)
    ends = _parts(text, sizes, max(1, limit - overlap), 0, None, cuts)
    before = sizes.before(np.array(ends)).tolist()
    pieces: list[tuple[int, int, int]] = []
    start, done, i = 0, 0, 0
    while done < len(text):
        first = int(sizes.before(np.array([start]))[0])
        j = max(i, bisect_right(before, first + limit) - 1)
        while (n := count(start, ends[j])) > limit and j > i:
            j -= 1
        end = ends[j]
        if n > limit and end - done > 1:  # not even one part beside the overlap: that part is split once more
            own = int(np.diff(sizes.before(np.array([done, end])))[0])
            finer = _parts(text, sizes, max(1, min(own - 1, limit - overlap - (n - limit))), done, end, cuts)
            if len(finer) == 1:
                finer = [(done + end) // 2, end]
            ends[j : j + 1] = finer
            before[j : j + 1] = sizes.before(np.array(finer)).tolist()
            continue
        pieces.append((start, end, n))
        done = end
        i = j + 1
        start = sizes.tail(end, overlap) if overlap else end
    return pieces


def split_texts(df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, path: str | None = None) -> DataFrame:
    """(key, piece_no, n_pieces, start_at, end_at, n_tokens, piece): every text in pieces of at most ``limit`` tokens.

    A text within the limit is one piece; null and empty texts have none.
    ``start_at`` and ``end_at`` are character places of the original text, so
    the pieces without their overlap give the text back. Each later piece
    starts at the least suffix of the one before that holds ``overlap`` of the
    whole text's tokens and begins with a whole character. Repeated rows are cut
    each for itself. One scan, no shuffle; texts of any length.
    """
    path = path or vocabulary()
    names = ["piece_no", "n_pieces", "start_at", "end_at", "n_tokens", "piece"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 500):
                rows, at = [], []
                for i in range(lo, min(lo + 500, len(texts))):
                    if t := texts[i]:
                        cut = split_text(enc, t, limit, overlap)
                        at += [i] * len(cut)
                        rows += [(k, len(cut), a, z, n, t[a:z]) for k, (a, z, n) in enumerate(cut)]
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [key, *names])

    src = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, piece_no int, n_pieces int, start_at long, end_at long, n_tokens int, piece string")
