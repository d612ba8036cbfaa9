"""Items that appear together: pair counts and association over baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def basket(items: Column) -> Column:
    """The distinct non-null items of one record, in order; null for a null array."""
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))


def pair_association(
    df: DataFrame,
    items: str,
    key: str | None = None,
    min_count: int = 10,
    min_share: float = 0.004,
    min_lift: float = 3.0,
) -> DataFrame:
    """Pairs of items with counts, lift and pointwise mutual information.

    Columns: item_a < item_b, n_both, n_a, n_b, n_records, lift, pmi (base 2).
    A pair comes out if ``n_both >= min_count``, ``n_both >= min_share * N`` and
    ``lift >= min_lift`` with N the records that hold at least one item.

    * ``key``: repeated rows of a key are one record, which holds the items of
      all of them; rows with a null key are records of their own.
    * Null items are left out, repeated items of a record count once, null and
      empty arrays are no records. An empty table gives no rows.
    * Only the two named columns are read, so other columns can't clash.

    With ``min_share`` 0 every pair of every record is counted. Else an item of
    a pair that comes out is itself in that many records: marginals
    are counted first, and pairs are emitted of such items only: the
    set of items is no larger than the mean basket divided by the share (a
    bound by counting), so it travels as one array value in each task, and a
    record emits at most the pairs within that set however long it is. All
    counts are combined on the map side before the shuffle; the shuffled pair
    counts are bounded by that set, too.
    """
    src = df.select(F.col(items).alias("items"), *([F.col(key).alias("k")] if key else []))
    if key:
        own = F.when(F.col("k").isNull(), F.monotonically_increasing_id())
        src = src.select("items", "k", own.alias("n")).groupBy("k", "n").agg(F.flatten(F.collect_set("items")).alias("items"))
    baskets = src.select(basket(F.col("items")).alias("b")).where(F.size("b") > 0)

    total = baskets.agg(F.count("*").alias("n"))
    floor = F.greatest(F.lit(min_count).cast("double"), F.col("n") * F.lit(min_share))
    single = baskets.select(F.explode("b").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    frequent = single.join(F.broadcast(total.select(floor.alias("floor"), "n"))).where(F.col("c") >= F.col("floor"))
    if min_share > 0:
        kept = frequent.agg(F.collect_list("item").alias("kept"))  # one row
        baskets = baskets.join(F.broadcast(kept)).select(F.array_sort(F.array_intersect("b", "kept")).alias("b"))
    cut = baskets.where(F.size("b") > 1)
    pairs = F.flatten(
        F.transform("b", lambda x, i: F.transform(F.slice("b", i + 2, F.size("b")), lambda y: F.struct(x.alias("item_a"), y.alias("item_b"))))
    )
    both = cut.select(F.explode(pairs).alias("p")).groupBy("p.item_a", "p.item_b").agg(F.count("*").alias("n_both"))
    a = frequent.select(F.col("item").alias("item_a"), F.col("c").alias("n_a"), F.col("n").alias("n_records"), "floor")
    b = frequent.select(F.col("item").alias("item_b"), F.col("c").alias("n_b"))
    lift = F.col("n_both") * F.col("n_records") / (F.col("n_a") * F.col("n_b"))
    return (
        both.join(a, "item_a")
        .join(b, "item_b")
        .where(F.col("n_both") >= F.col("floor"))
        .select("item_a", "item_b", "n_both", "n_a", "n_b", "n_records", lift.alias("lift"), F.log2(lift).alias("pmi"))
        .where(F.col("lift") >= min_lift)
    )
