"""Verdicts against labels, and weights fitted to them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

TARGETS = {"phishing": 100.0, "phish": 100.0, "confirmed_phish": 100.0, "suspicious": 50.0, "review": 50.0, "clean": 0.0, "confirmed_clean": 0.0}


def judged(results: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``results`` (key, verdict, score, signals) beside what was expected, with ``ok``.

    ``expected``: key, want_verdict, min_score, max_score, want_signals; null
    bounds and signals ask nothing. A result without an expectation has a null ``ok``.
    """
    d = results.join(expected, key, "left")
    missing = F.size(F.array_except(F.coalesce("want_signals", F.array().cast("array<string>")), F.coalesce("signals", F.array().cast("array<string>")))) > 0
    ok = (F.col("verdict") == F.col("want_verdict")) & (F.col("score") >= F.coalesce("min_score", F.lit(0))) & (F.col("score") <= F.coalesce("max_score", F.lit(100))) & ~missing
    return d.withColumn("ok", F.when(F.col("want_verdict").isNotNull(), ok))


def class_metrics(d: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1) of judged rows.

    A row that is not ok counts against the class it should be and the class it was given, even if they are one.
    """
    d = d.where("ok IS NOT NULL")
    hits = F.when(F.col("ok"), F.array(F.struct(F.col("want_verdict").alias("class"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"), F.lit(1).alias("support")))).otherwise(
        F.array(F.struct(F.col("want_verdict").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"), F.lit(1).alias("support")), F.struct(F.col("verdict").alias("class"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"), F.lit(0).alias("support")))
    )
    c = d.select(F.explode(hits).alias("h")).groupBy("h.class").agg(*(F.sum(f"h.{x}").alias(x) for x in ("tp", "fp", "fn", "support")))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    c = c.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    return c.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def macro(d: DataFrame) -> DataFrame:
    """(macro_f1, accuracy, n): the mean F1 of the classes that occur, and the share of rows that are ok."""
    m = class_metrics(d).where("support > 0").agg(F.avg("f1").alias("macro_f1"))
    return m.join(F.broadcast(d.where("ok IS NOT NULL").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"), F.count("*").alias("n"))))


def binary_metrics(df: DataFrame, predicted: str, actual: str, positive: str = "phishing") -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1) of one class against the rest; null labels are left out."""
    p, a = F.col(predicted) == positive, F.col(actual) == positive
    c = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    c = c.withColumns({"precision": F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0)), "recall": F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))})
    return c.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def checked_examples(df: DataFrame) -> DataFrame:
    """Labelled examples (label, signals map of confidences), or an error that names what is wrong with one."""
    known = F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv))
    target = F.try_element_at(known, F.lower("label"))
    bad = F.when(target.isNull(), F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))).when(F.coalesce(F.size("signals"), F.lit(0)) <= 0, "an example without signals").when(F.exists(F.map_values("signals"), lambda v: v.isNull() | (v < 0) | (v > 1)), "a confidence outside 0 to 1")
    return df.select(F.when(bad.isNotNull(), F.raise_error(bad).cast("double")).otherwise(target).alias("target"), "signals")


def moments(examples: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, int]:
    """Signal ids, the sums of products of confidences, of confidences and targets, counts, and the number of examples.

    Their size is bounded by the registered ids, not by the rows; one pass over the pairs within each example makes them.
    """
    e = examples.select("target", F.map_entries("signals").alias("s"))
    pairs = e.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: F.struct(a["key"].alias("a"), b["key"].alias("b"), (a["value"] * b["value"]).alias("v")))))).alias("p"))
    xx = pairs.groupBy("p.a", "p.b").agg(F.sum("p.v").alias("v")).collect()
    xy = e.select("target", F.explode("s").alias("s")).groupBy("s.key").agg(F.sum(F.col("s.value") * F.col("target")).alias("v"), F.count("*").alias("n")).collect()
    n = examples.count()
    ids = sorted(r[0] for r in xy)
    at = {k: i for i, k in enumerate(ids)}
    gram, cross, counts = np.zeros((len(ids), len(ids))), np.zeros(len(ids)), np.zeros(len(ids))
    for a, b, v in xx:
        gram[at[a], at[b]] = v
    for k, v, m in xy:
        cross[at[k]], counts[at[k]] = v, m
    return ids, gram, cross, counts, n


def tuned_weights(examples: DataFrame, base: dict[str, float], rate: float = 0.002, pull: float = 0.0005, epochs: int = 2500) -> dict[str, int]:
    """Weights fitted to labels by gradient descent that pulls towards the base weights, within -100 and 100, rounded.

    The gradient needs only the moments of the examples, so they are summed in
    Spark once and the descent runs on a small matrix. A signal is pulled once
    for each example that holds it.
    """
    ids, gram, cross, counts, n = moments(checked_examples(examples))
    prior = np.array([float(base.get(i, 0.0)) for i in ids])
    w = prior.copy()
    for _ in range(epochs if n else 0):
        w = w - rate * (gram @ w - cross + pull * counts * (w - prior)) / n
    return dict(base) | {i: int(np.sign(x) * np.floor(abs(x) + 0.5)) for i, x in zip(ids, np.clip(w, -100, 100))}


def label_export(df: DataFrame, label: str, signals: str) -> DataFrame:
    """(value): one JSON object with label and signals for each row."""
    return df.select(F.to_json(F.struct(F.col(label).alias("label"), F.col(signals).alias("signals"))).alias("value"))
