"""Byte-level BPE by a segment tree, with the files of public tokenizers.

A pre-token's adjacent pairs are the leaves of a segment tree that holds the
least (rank, position); its root is the leftmost merge of the lowest rank. A
merge changes three leaves, so a pre-token of n bytes takes O(n log n) however
long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Where the public files lie; a parameter of every operator that needs them.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pre-token pattern that belongs to byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 62
SHIFT = 32


class Encoder:
    """Texts to ids. ``memo_words`` bounds the words whose ids are remembered; it changes speed, never results."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memo_words: int = 400_000) -> None:
        self.ranks, self.memo_words = ranks, memo_words
        self.split = regex.compile(pattern).findall
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.bytes_of: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.width = np.zeros(max(ranks.values()) + 1, np.int32)
        for b, i in ranks.items():
            self.width[i] = len(b)
        self.pairs: dict[tuple[int, int], int] = {}
        self.tokens: dict[str, bytes] = {}
        self.words = _Words(self)

    def _pair(self, a: int, b: int) -> int:
        """The id of the merge of two ids, which is its rank; NEVER if they don't merge."""
        r = self.pairs.get((a, b))
        if r is None:
            r = self.pairs[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NEVER)
        return r

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        tok = [self.byte[b] for b in raw]
        n = len(tok)
        if n < 2:
            return tok
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NEVER] * (2 * size)
        pair = self._pair
        for i in range(n - 1):
            if (r := pair(tok[i], tok[i + 1])) != NEVER:
                tree[size + i] = r << SHIFT | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, v: int) -> None:
            i += size
            tree[i] = v
            while i > 1:
                v = min(v, tree[i ^ 1])
                i >>= 1
                if tree[i] == v:
                    return
                tree[i] = v

        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        while (top := tree[1]) != NEVER:
            i = top & ((1 << SHIFT) - 1)
            j = nxt[i]
            tok[i], tok[j] = top >> SHIFT, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
            if j < n - 1:
                put(j, NEVER)
            r = pair(tok[i], tok[k]) if k < n else NEVER
            put(i, r << SHIFT | i if r != NEVER else NEVER)
            if (p := prv[i]) >= 0:
                r = pair(tok[p], tok[i])
                put(p, r << SHIFT | p if r != NEVER else NEVER)
        return [t for t in tok if t >= 0]

    def pre_token(self, s: str) -> bytes:
        """The ids of one pre-token as int32 bytes."""
        if (out := self.tokens.get(s)) is None:
            out = np.array(self.merge(s.encode("utf-8", "surrogatepass")), np.int32).tobytes()
            if len(s) <= 64:
                if len(self.tokens) >= self.memo_words:
                    self.tokens.clear()
                self.tokens[s] = out
        return out

    def direct(self, text: str) -> bytes:
        return b"".join(map(self.pre_token, self.split(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32 bytes.

        A pre-token starts before every blank that stands before a character
        that is no white space, and nothing after that place changes what comes
        before it. So a text is cut at its blanks, and each word with its blank
        is looked up at once. Where white space follows a blank, the parts stay
        together.
        """
        parts = text.split(" ")
        words = self.words
        if words.full():
            words.clear()
        out = list(map(words.__getitem__, parts[1:]))
        if None not in out:
            return self.direct(parts[0]) + b"".join(out)
        done: list[bytes] = []
        held, ids = parts[0], None  # the part so far, and its ids where it is one known word
        for p, o in zip(parts[1:], out):
            if o is None:
                held, ids = f"{held} {p}", None
            else:
                done.append(self.direct(held) if ids is None else ids)
                held, ids = " " + p, o
        done.append(self.direct(held) if ids is None else ids)
        return b"".join(done)

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), np.int32).tolist() if text else []


class _Words(dict):
    """Ids of a blank and the word after it; None where the word can't stand for itself."""

    def __init__(self, enc: Encoder) -> None:
        super().__init__()
        self.enc = enc

    def full(self) -> bool:
        return len(self) >= self.enc.memo_words

    def __missing__(self, word: str) -> bytes | None:
        if not word or word[0].isspace():
            return None
        ids = self.enc.direct(" " + word)
        if len(word) <= 64 and not self.full():
            self[word] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; one a worker process, kept over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


def list_array(parts: list[bytes]) -> pa.Array:
    """An array of int lists from int32 bytes."""
    at = np.fromiter(accumulate((len(p) // 4 for p in parts), initial=0), np.int32, len(parts) + 1)
    values = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(at), values)


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): each row's text as the ids of the vocabulary, without special tokens.

    Strings that look like special tokens are ordinary text. A null and an
    empty text have an empty list. Every row comes out once, repeated and null
    keys included; other columns are not read. Texts of any length are encoded
    whole, in one scan and without a shuffle.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), list_array([enc.encode(t) if t else b"" for t in b.column(1).to_pylist()])], [key, "ids"])

    src = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, ids array<int>")
