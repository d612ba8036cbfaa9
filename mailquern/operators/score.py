"""Signals of a mail folded into score, verdict, confidence, attack type and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailquern import refdata
from mailquern.functions.text import lookup_map, round_half_up

ADVICE = {
    "clean": "No action is needed.", "suspicious": "Treat the message with care.", "needs_review": "Wait for an analyst's decision.", "phishing": "Do not act on the message.",
    "no_click": "Do not follow its links.", "no_credentials": "Do not enter passwords or codes.", "no_attachment": "Do not open its attachments.",
    "verify_sender": "Confirm the request with the sender by another way.", "report": "Report it to security.",
}


def contribution(s: Column) -> Column:
    return s["weight"] * s["confidence"]


def reweighted(signals: Column, weights: dict[str, float] | None) -> Column:
    """Signals with the weights of an organisation in place of the registered ones."""
    if not weights:
        return signals
    own = lookup_map(weights)
    return F.transform(signals, lambda s: s.withField("weight", F.coalesce(F.try_element_at(own, s["id"]), s["weight"])))


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with columns that the optimizer takes as they are.

    It copies the expression of a column into filters and projections above it.
    With columns built on each other over several steps the copies multiply;
    a condition that counts as random, and always holds, ends that.
    """
    return df.withColumns({c: F.when(F.rand(0) >= 0, F.col(c)) for c in columns})


def _has(prefix: str) -> Column:
    return F.exists("signals", lambda s: s["id"].startswith(prefix) & (s["weight"] > 0))


def score_messages(df: DataFrame, weights: dict[str, float] | None = None, phishing: int = refdata.THRESHOLDS["phishing"], suspicious: int = refdata.THRESHOLDS["suspicious"]) -> DataFrame:
    """``df`` (with ``signals`` in emission order) with score, verdict, confidence, attack_type, recommendations, and signals by weight.

    The sum of weight times confidence is rounded, halves away from zero, and
    kept within 0 and 100. A blocked sender makes phishing of at least the
    threshold; a feed's hit makes a clean mail suspicious; an opinion that
    contradicts a strong signal, or an allowed sender with a phishing score, is
    left to review. ``llm`` is read if the column is there. A null array of
    signals counts as empty.
    """
    llm = F.col("llm.verdict_opinion") if "llm" in df.columns else F.lit(None).cast("string")
    d = df.withColumn("signals", F.coalesce(reweighted(F.col("signals"), weights), F.array().cast("array<struct<id:string,category:string,weight:double,confidence:double,evidence:string,source:string>>")))
    d = settled(d, "signals")
    total = F.aggregate("signals", F.lit(0.0), lambda a, s: a + contribution(s))
    d = d.withColumn("__raw", F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(total))).cast("int"))
    d = d.withColumns({
        "__block": F.exists("signals", lambda s: s["id"] == "reputation.org_blocklist"), "__allow": F.exists("signals", lambda s: s["id"] == "reputation.org_allowlist"),
        "__ti": F.exists("signals", lambda s: (s["source"] == "ti") & (s["weight"] > 0)),
        "__strong": F.exists("signals", lambda s: (s["weight"] >= 25) & (s["confidence"] >= 0.8) & (s["category"] != "semantic")),
        "__by_score": F.when(F.col("__raw") >= phishing, "phishing").when(F.col("__raw") >= suspicious, "suspicious").otherwise("clean"),
    })
    raised = F.col("__ti") & (F.col("__by_score") == "clean")
    d = d.withColumn("score", F.when(F.col("__block"), F.greatest("__raw", F.lit(phishing))).when(raised, F.greatest("__raw", F.lit(suspicious))).otherwise(F.col("__raw")))
    d = d.withColumn("__ruled", F.when(F.col("__block"), "phishing").when(raised, "suspicious").otherwise(F.col("__by_score")))
    unsure = (F.col("__strong") & (llm == "clean") & (F.col("__ruled") != "clean")) | (F.col("__allow") & (F.col("score") >= phishing))
    d = d.withColumn("verdict", F.when(~F.col("__block") & F.coalesce(unsure, F.lit(False)), "needs_review").otherwise(F.col("__ruled")))
    d = settled(d, "score", "verdict")
    positives = F.size(F.filter("signals", lambda s: (s["weight"] > 0) & (s["category"] != "semantic")))
    near = F.least(F.abs(F.col("score") - phishing), F.abs(F.col("score") - suspicious))
    agrees = F.when(llm == "phishing", F.col("score") >= phishing).when(llm == "clean", F.col("score") < suspicious).when(llm == "suspicious", (F.col("score") >= suspicious) & (F.col("score") < phishing)).otherwise(False)
    sure = 0.5 + F.least(F.lit(0.3), near / 100.0) + F.least(F.lit(0.15), positives * 0.03) + F.when(llm.isNull(), 0.0).when(agrees, 0.05).otherwise(-0.1)
    told = F.col("llm.attack_type") if "llm" in df.columns else F.lit(None).cast("string")
    attack = (
        F.when(told.isin([t for t in refdata.ATTACK_TYPES if t != "none"]), told)
        .when(F.col("verdict") == "clean", "none")
        .when(_has("attachment."), "malware")
        .when(_has("content.bec_pattern"), "bec")
        .when(_has("content.finance_request") & ~_has("link."), "invoice_fraud")
        .when(_has("content.credential_request") | _has("link.") | _has("brand."), "credential_harvesting")
        .otherwise("spam")
    )
    by_verdict = F.create_map(*(F.lit(x) for v in refdata.VERDICTS for x in (v, ADVICE[v])))
    acts = F.col("verdict") != "clean"
    said = F.col("llm.recommended_action") if "llm" in df.columns else F.lit(None).cast("string")
    advice = F.array_compact(F.array(
        F.element_at(by_verdict, F.col("verdict")), F.when(acts & (_has("link.") | _has("brand.")), ADVICE["no_click"]), F.when(acts & _has("content.credential_request"), ADVICE["no_credentials"]),
        F.when(acts & _has("attachment."), ADVICE["no_attachment"]), F.when(acts & (_has("content.bec_pattern") | _has("content.finance_request") | _has("domain.free_mail_org")), ADVICE["verify_sender"]),
        F.when(acts & (said != ""), said), F.when(acts, ADVICE["report"]),
    ))
    d = d.withColumns({"confidence": F.floor(F.greatest(F.lit(0.1), F.least(F.lit(0.99), sure)) * 100 + 0.5) / 100, "attack_type": attack, "recommendations": advice})
    return d.withColumn("signals", ranked(F.col("signals"))).drop("__raw", "__block", "__allow", "__ti", "__strong", "__by_score", "__ruled")


def ranked(signals: Column) -> Column:
    """Signals by the size of their contribution, the largest first, those of one size in emission order."""
    keyed = F.transform(signals, lambda s, i: F.struct((-F.abs(contribution(s))).alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def signals_from_ids(ids: Column, confidence: Column, weights: dict[str, float] | None = None) -> Column:
    """Signals in emission order from an array of ids; unknown ids weigh nothing, null and repeated ones are left out."""
    own = refdata.WEIGHTS | (weights or {})
    w = lookup_map(own)
    stage = lambda i: F.when(i.startswith("reputation."), 1).when(i.startswith("semantic."), 2).otherwise(0)
    order = F.array_sort(F.transform(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())), lambda i: F.struct(stage(i).alias("n"), i.alias("id"))))
    source = lambda i: F.when(i.isin("reputation.domain_listed", "header.received_ip_listed"), "ti").when(i.startswith("semantic."), "llm").otherwise("heuristic")
    return F.transform(order, lambda o: F.struct(o["id"].alias("id"), F.substring_index(o["id"], ".", 1).alias("category"), F.coalesce(F.try_element_at(w, o["id"]), F.lit(0.0)).alias("weight"), confidence.cast("double").alias("confidence"), F.lit("").alias("evidence"), source(o["id"]).alias("source")))


def merged_weights(base: dict[str, float], org: dict[str, float] | None) -> dict[str, float]:
    return base | (org or {})
