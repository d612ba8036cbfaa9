"""Most frequent items with bounded memory: Misra-Gries summaries, merged and then counted exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

SUMMARY = "field string, item string, low long"


class MisraGries:
    """At most ``k`` counters; ``add`` takes counts of any size, so summaries merge by adding their counters.

    When more than ``k`` counters are held, the (k+1)-th largest count is taken
    from all and those that reach zero go. Each such step takes that count from
    at least k+1 counters, so an item is undercounted by no more than
    (all counts added) / (k + 1): an item above that share is always kept.
    """

    def __init__(self, k: int) -> None:
        self.k, self.counts = k, {}

    def add(self, items: list, counts: list[int]) -> None:
        own = self.counts
        for x, n in zip(items, counts):
            own[x] = own.get(x, 0) + n
        if len(own) > self.k:
            cut = sorted(own.values(), reverse=True)[self.k]
            self.counts = {x: n - cut for x, n in own.items() if n > cut}


def clean_item(c: Column) -> Column:
    """In lower case and without blanks of any kind at either end; empty becomes null."""
    blank = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    return F.nullif(F.lower(F.regexp_replace(c, f"^{blank}|{blank}$", "")), F.lit(""))


def _summarise(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_field: dict[str, MisraGries] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            weighted = "low" in t.column_names
            for field in pc.unique(t["field"]).to_pylist():
                part = t.filter(pc.equal(t["field"], field)) if field is not None else t.filter(pc.is_null(t["field"]))
                summary = by_field.setdefault(field, MisraGries(k))
                if weighted:
                    summary.add(part["item"].to_pylist(), part["low"].to_pylist())
                else:
                    vc = pc.value_counts(part["item"].combine_chunks())
                    summary.add(vc.field("values").to_pylist(), vc.field("counts").to_pylist())
        rows = [(f, x, n) for f, s in by_field.items() for x, n in s.counts.items()]
        if rows:
            f, x, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(x, pa.string()), pa.array(n, pa.int64())], ["field", "item", "low"])

    return run


def heavy_candidates(values: DataFrame, k: int, fan_in: int = 64) -> DataFrame:
    """(field, item, low): the at most ``k`` candidates of each field that any frequent item is among.

    ``values`` has the columns field and item. A task keeps ``k`` counters a
    field; summaries of at most k rows are merged in two rounds, each in a
    stream, so a task's memory doesn't grow with the partitions.
    """
    first = values.mapInArrow(_summarise(k), SUMMARY)
    merged = first.repartition(fan_in, F.spark_partition_id() % fan_in).mapInArrow(_summarise(k), SUMMARY)
    return merged.repartition(1).mapInArrow(_summarise(k), SUMMARY)


def heavy_hitters(values: DataFrame, min_share: float = 0.005, min_count: int = 8, slack: float = 5.0) -> DataFrame:
    """(field, item, n, n_field): items that make at least ``min_share`` of their field's values and occur ``min_count`` times.

    Null items are left out. ``slack`` sets the counters kept, slack / min_share
    (1,000 by default): by the summary's guarantee no item above
    ``min_share / slack`` of the values is missed, whatever the order or the
    number of distinct values. The candidates - at most k a field, which bounds
    what is broadcast - are then counted exactly in a second pass. An empty
    table gives no rows.
    """
    values = values.where(F.col("item").isNotNull()).select("field", "item")
    k = math.ceil(slack / min_share)
    cand = heavy_candidates(values, k).select("field", "item").distinct()
    counts = values.join(F.broadcast(cand), ["field", "item"], "left_semi").groupBy("field", "item").agg(F.count("*").alias("n"))
    totals = values.groupBy("field").agg(F.count("*").alias("n_field"))
    return counts.join(totals, "field").where((F.col("n") >= min_count) & (F.col("n") >= F.col("n_field") * min_share)).select("field", "item", "n", "n_field")
