"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp that means UTC, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row for each non-null key: repeated rows of a key are one record.

    Rows without a key are left out: they can't be reported. Of differing rows
    with one key an arbitrary one stays; callers for which that matters
    aggregate instead.
    """
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])
