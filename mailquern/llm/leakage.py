"""Evaluation passages inside a corpus: a prefix-filtered set join of word shingles with exact containment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailquern.session import checkpointed

#: Characters that show nothing: format characters, fillers and variation selectors.
_SILENT = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text between blanks and punctuation, in lower case and without what shows nothing."""
    if not text.isascii():
        text = _SILENT.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


def _runs(vocabulary: dict[str, int], least: int, key: str):
    """Per text: its longest stretches of words of the vocabulary, as ids, from ``least`` words on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                w = words(text)
                ids = np.fromiter(map(vocabulary.get, w, repeat(-1)), np.int32, len(w))
                gaps = np.flatnonzero(np.concatenate(([True], ids < 0, [True])))
                for j in np.flatnonzero(np.diff(gaps) > least):
                    keys.append(i)
                    out.append(ids[gaps[j] : gaps[j + 1] - 1])
            if keys:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys)), pa.array(out, pa.list_(pa.int32()))], [key, "run"])

    return run


def _key_type(df: DataFrame, c: str) -> str:
    return df.select(c).schema[0].dataType.simpleString()


def _shingles(df: DataFrame, ids: str, n: int, *keep: str | Column) -> DataFrame:
    """One row for each shingle of an id array: its place ``at`` from 0 and its hash ``sh``."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(ids) - n + 1), lambda i: F.xxhash64(F.slice(F.col(ids), i, n)))
    return df.where(F.size(ids) >= n).select(*keep, ids, F.posexplode(hashes).alias("at", "sh"))


def _blocks(items: DataFrame, item_id: str, passage: str, block_words: int) -> Iterator[list[tuple]]:
    block, n = [], 0
    for row in items.where(F.col(passage).isNotNull()).select(item_id, passage).toLocalIterator():
        w = words(row[1])
        block.append((row[0], w))
        n += len(w)
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, least: int = 12, shingle: int = 5, block_words: int = 400_000) -> DataFrame:
    """Distinct (doc_id, item_id): documents that hold ``least`` consecutive words of an item's passage.

    Letter case, punctuation, white space and characters that show nothing are
    set aside. The items are a stated query set, taken in blocks of
    ``block_words`` words, which bounds what is broadcast; there is no limit to
    their number. Null texts and passages hold nothing, nor do passages of
    fewer than ``least`` words. Repeated rows and extra columns change nothing.

    For each item-sized window of ``least`` words all its shingles must be in
    the document, so the rarest by corpus frequency - the necessary prefix -
    is joined alone; a window with a shingle that no document has is dropped.
    A candidate must lie inside the document's stretch (length and position)
    and match the window word for word.
    """
    src = docs.where(F.col(text).isNotNull()).select(doc_id, text)
    kind, ikind = _key_type(docs, doc_id), _key_type(items, item_id)
    spark = docs.sparkSession
    parts = []
    for block in _blocks(items, item_id, passage, block_words):
        vocabulary: dict[str, int] = {}
        passages = [(i, [vocabulary.setdefault(w, len(vocabulary)) for w in ws]) for i, ws in block]
        if not vocabulary:
            continue
        runs = checkpointed(src.mapInArrow(_runs(vocabulary, least, doc_id), f"`{doc_id}` {kind}, run array<int>").distinct())
        held = _shingles(runs, "run", shingle, doc_id)
        rarity = held.groupBy("sh").agg(F.count("*").alias("freq"))

        known = spark.createDataFrame(passages, f"`{item_id}` {ikind}, words array<int>").where(F.size("words") >= least)
        own = _shingles(known, "words", shingle, item_id).join(rarity, "sh", "left")
        span = least - shingle  # a window's shingles start at 0..span within it
        starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(span)), lambda o: F.col("at") - o), lambda s: (s >= 0) & (s + least <= F.size("words")))
        in_windows = own.select(item_id, "words", "at", "sh", "freq", F.explode(starts).alias("start"))
        prefix = (
            in_windows.groupBy(item_id, "start")
            .agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), F.col("at"), F.col("sh"))).alias("rarest"), F.first(F.slice("words", F.col("start") + 1, least)).alias("window"))
            .where(F.col("rarest.freq") > 0)
            .select(item_id, "window", F.col("rarest.sh").alias("sh"), (F.col("rarest.at") - F.col("start")).alias("offset"))
        )
        hit = held.join(F.broadcast(prefix), "sh")
        at = F.col("at") - F.col("offset")
        inside = hit.where((at >= 0) & (at + least <= F.size("run")))
        parts.append(inside.where(F.slice("run", at + 1, least) == F.col("window")).select(doc_id, item_id).distinct())
    if not parts:
        return spark.createDataFrame([], f"`{doc_id}` {kind}, `{item_id}` {ikind}")
    return reduce(DataFrame.unionByName, parts)
