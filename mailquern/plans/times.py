"""Problem 4: mixed timestamp formats and time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailquern.operators import timestamps as T
from mailquern.plans.queries import R
from mailquern.tables import table


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orgs, hosts = table(spark, sf, "orgs"), table(spark, sf, "mail_hosts")
    return T.normalised_submissions(table(spark, sf, "submissions"), orgs), T.normalised_hops(table(spark, sf, "received_hops"), hosts)


@R.query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions whose reception isn't their event's instant, and hops whose two times differ."""
    subs, hops = _sides(spark, sf)
    secs = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("event_ts").cast("timestamp_ntz"))
    events = table(spark, sf, "notify_events").where(F.col("submission_id").isNotNull() & F.col("event_ts").isNotNull()).groupBy("submission_id").agg(F.collect_set(secs).alias("event"))
    told = subs.where(F.col("time_secs").isNotNull()).join(events, "submission_id")
    wrong = told.where(~F.coalesce(T.same_instant(F.col("meant"), F.col("event"), F.col("time_minute")), F.lit(False)) & F.col("meant").isNotNull())
    differ = hops.where(F.col("noted_meant").isNotNull() & F.col("raw_meant").isNotNull()).where(~F.coalesce(T.same_instant(F.col("noted_meant"), F.col("raw_meant"), F.col("noted_minute") | F.col("raw_minute")), F.lit(False)))
    return wrong.select(F.lit("submission").alias("record_kind"), F.col("submission_id").alias("record_key")).unionByName(differ.select(F.lit("hop").alias("record_kind"), F.col("hop_id").cast("string").alias("record_key")))


@R.query("p4_instants")
def p4_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Every reception and hop time as its one instant; of two meanings the earlier, null where there is none."""
    subs, hops = _sides(spark, sf)
    at = lambda c: F.timestamp_seconds(F.array_min(c)).alias("instant")
    return (
        subs.select(F.lit("received_at").alias("field_name"), F.col("submission_id").alias("record_key"), at("meant"))
        .unionByName(hops.select(F.lit("hop_ts").alias("field_name"), F.col("hop_id").cast("string").alias("record_key"), at("noted_meant")))
        .unionByName(hops.select(F.lit("hop_raw").alias("field_name"), F.col("hop_id").cast("string").alias("record_key"), at("raw_meant")))
    )
