"""Streams of messages, status events and analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def landing(spark: SparkSession, folder: str, glob: str = "*.eml", per_trigger: int = 1000) -> DataFrame:
    """(path, kind, content) of messages as they land in a folder; the checkpoint holds what was read."""
    from mailquern.sources.mail import kind_of

    d = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
    return d.select("path", kind_of(F.col("path"), F.col("content")).alias("kind"), "content")


def table_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def deduplicated(events: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Each key once, however often it is delivered within ``delay``."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def _late(events: DataFrame, time: str, delay: str | None) -> DataFrame:
    """``events`` with a watermark; ``delay`` is None where they have one already."""
    return events.withWatermark(time, delay) if delay else events


def tumbling_counts(events: DataFrame, time: str, by: str, width: str = "1 day", delay: str | None = "3 days") -> DataFrame:
    """(start, by, n) of windows that close once the watermark has passed them."""
    return _late(events, time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def bursts(events: DataFrame, time: str, by: str, width: str = "10 minutes", slide: str = "5 minutes", least: int = 20, delay: str | None = "1 hour") -> DataFrame:
    """(start, by, n) of sliding windows in which a value occurs at least ``least`` times."""
    return _late(events, time, delay).groupBy(F.window(time, width, slide).alias("w"), by).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("w.start").alias("start"), by, "n")


def campaign_sessions(events: DataFrame, time: str, key: str, gap: str = "1 hour", delay: str | None = "1 hour") -> DataFrame:
    """(start, end, key, n): runs of a campaign's messages with no gap above ``gap``."""
    return _late(events, time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def current_status(events: DataFrame, key: str, status: str, time: str) -> DataFrame:
    """(key, status, at): the last status of each key so far, for output mode update or complete."""
    return events.groupBy(key).agg(F.max_by(status, time).alias(status), F.max(time).alias("at"))


def bound_orgs(messages: DataFrame, chat: str, bind: str, org: str, out_schema: str) -> DataFrame:
    """Chat messages with the organisation their chat was last bound to, kept as state by chat."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, pdfs, state: GroupState):
        bound = state.get[0] if state.exists else None
        for pdf in pdfs:
            orgs = []
            for b, o in zip(pdf[bind], pdf[org]):
                bound = o if b else bound
                orgs.append(bound)
            yield pd.DataFrame({chat: pdf[chat], "org": orgs})
        state.update((bound,))

    return messages.groupBy(chat).applyInPandasWithState(run, out_schema, "org string", "append", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, path: str, checkpoint: str, key: str, time: str | None = None) -> DataStreamWriter:
    """Upserts of each batch into a Parquet table.

    A batch replaces the rows of its keys: the table is written beside the old
    one under the batch's number and then named by a pointer row, so a batch
    that is run again leaves the same table.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        from mailquern.operators.analytics import upserted

        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), time or key).alias("r")).select("r.*")
        try:
            old = current_table(spark, path, epoch)
        except FileNotFoundError:
            old = None
        (new if old is None else upserted(old, new, key)).write.mode("overwrite").parquet(f"{path}/v={epoch:012d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def current_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The last version of a table that ``into_table`` keeps, or the last before a batch."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    mine = [n for n in names if n.startswith("v=") and (before is None or int(n[2:]) < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if not mine:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{mine[-1]}")


def notify(stream: DataFrame, deliver: Callable[[DataFrame], None], at_least: str = "suspicious") -> DataStreamWriter:
    """Events from a verdict on to ``deliver``, batch by batch."""
    from mailquern import refdata
    from mailquern.operators.export import verdict_rank

    return stream.where(verdict_rank(F.col("verdict")) >= refdata.VERDICTS.index(at_least)).writeStream.foreachBatch(lambda batch, _: deliver(batch))
