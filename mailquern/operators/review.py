"""What analysts decide, as changes of tables and rows of an audit log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

STATUSES = ("in_review", "confirmed_phish", "confirmed_clean", "escalated")
AUDIT = ("org_id", "actor", "action", "target", "details")


def _audit(df: DataFrame, actor: Column, action: str, target: str, details: Column) -> DataFrame:
    return df.select("org_id", actor.alias("actor"), F.lit(action).alias("action"), F.col(target).alias("target"), details.alias("details"))


def reviewed(submissions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submissions with the decided status and reviewer, audit rows) for ``decisions`` (submission_id, status, actor, decided_at).

    The last decision of a submission stands, every one of a known submission is
    audited. An escalation is audited as an incident.
    """
    known = decisions.where(F.col("status").isin(*STATUSES)).join(submissions.select("submission_id", "org_id"), "submission_id")
    last = known.groupBy("submission_id").agg(F.max_by(F.struct("status", "actor"), F.struct("decided_at", "status")).alias("__d"))
    d = submissions.join(last, "submission_id", "left").withColumns({"review_status": F.coalesce("__d.status", "review_status"), "reviewed_by": F.coalesce("__d.actor", "reviewed_by")}).drop("__d")
    told = known.withColumn("__action", F.when(F.col("status") == "escalated", "incident.create").otherwise("submission.review"))
    audit = told.select("org_id", "actor", F.col("__action").alias("action"), F.col("submission_id").alias("target"), F.when(F.col("status") == "escalated", F.lit("")).otherwise(F.col("status")).alias("details"))
    return d, audit


def bulk_reviewed(submissions: DataFrame, ids: Sequence[str], status: str, actor: str, org_id: str = "") -> tuple[DataFrame, DataFrame]:
    """The same for one decision over 1 to 100 submissions, all of them known and of ``org_id`` if that is given, else an error."""
    wanted = [i.strip() for i in ids]
    if not 1 <= len(wanted) <= 100 or "" in wanted:
        raise ValueError("between 1 and 100 submission ids are required, none of them empty")
    if status not in STATUSES:
        raise ValueError("invalid bulk status")
    own = submissions.where(F.col("submission_id").isin(wanted) & (F.lit(org_id == "") | (F.col("org_id") == org_id)))
    if own.select("submission_id").distinct().count() != len(set(wanted)):
        raise LookupError("a submission is unknown or of another organisation")
    hit = F.col("submission_id").isin(wanted)
    d = submissions.withColumns({"review_status": F.when(hit, F.lit(status)).otherwise(F.col("review_status")), "reviewed_by": F.when(hit, F.lit(actor)).otherwise(F.col("reviewed_by"))})
    return d, _audit(own.dropDuplicates(["submission_id"]), F.lit(actor), "submission.bulk_review", "submission_id", F.lit(status))


def blockable(value: Column) -> Column:
    """The domain in lower case, null where it is empty, an address, or holds what no domain does."""
    v = F.lower(F.trim(value))
    return F.when((v != "") & ~v.rlike(r"[/ @:]") & ~v.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), v)


def blocked_domains(submissions: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(list entries, audit rows, refused orders) for ``orders`` (submission_id, domain, actor): a domain goes to the list of its submission's organisation."""
    d = orders.join(submissions.select("submission_id", "org_id").dropDuplicates(["submission_id"]), "submission_id", "left").withColumn("value", blockable(F.col("domain")))
    ok = d.where(F.col("value").isNotNull() & F.col("org_id").isNotNull())
    entries = ok.select("org_id", F.lit("block").alias("kind"), "value", F.col("actor").alias("created_by"), F.concat(F.lit("from submission "), "submission_id").alias("note")).dropDuplicates(["org_id", "kind", "value"])
    return entries, _audit(ok, F.col("actor"), "domain.block", "value", F.col("submission_id")), d.where(F.col("value").isNull() | F.col("org_id").isNull()).select("submission_id", "domain", "actor")
