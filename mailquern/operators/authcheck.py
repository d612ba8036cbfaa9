"""SPF and DMARC of mails without a verdict of their own, from tables of published records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailquern.functions.hosts import aligned, dmarc_tags, is_private_ip, registrable_domain

RESULTS = {"+": "pass", "-": "fail", "~": "softfail", "?": "neutral"}


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    p = F.split(ip, r"\.")
    return F.when(ip.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), sum((p[i].cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long")))


def spf_terms(records: DataFrame, depth: int = 4) -> DataFrame:
    """(domain, at, low, high, result) of published SPF records: the ranges of addresses in order, and the final ``all``.

    ``records``: name, txt. Included records count with the ranges they pass, up
    to ``depth`` levels down; ``redirect`` takes the other record's place at the
    end. Ranges are IPv4. Records meet by joins on the included name.
    """
    spf = records.where(F.lower("txt").startswith("v=spf1")).groupBy(F.lower("name").alias("domain")).agg(F.min("txt").alias("txt"))
    words = spf.select("domain", F.posexplode(F.filter(F.split(F.lower("txt"), r"\s+"), lambda w: w != "v=spf1")).alias("at", "word"))
    sign = F.when(F.col("word").rlike(r"^[+\-~?]"), F.left("word", F.lit(1))).otherwise("+")
    w = words.withColumns({"sign": sign, "word": F.regexp_replace("word", r"^[+\-~?]", "")})
    bits = F.coalesce(F.nullif(F.regexp_extract("word", r"/(\d+)$", 1), F.lit("")).cast("int"), F.lit(32))
    base = ip_number(F.regexp_extract("word", r"^ip4:([0-9.]+)", 1))
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    low = base - base % size
    ranges = w.where("word LIKE 'ip4:%'").select("domain", F.array("at").alias("at"), low.alias("low"), (low + size - 1).alias("high"), "sign")
    ranges = ranges.unionByName(w.where("word = 'all'").select("domain", F.array("at").alias("at"), F.lit(0).cast("long").alias("low"), F.lit((1 << 32) - 1).cast("long").alias("high"), "sign"))
    links = w.where("word LIKE 'include:%' OR word LIKE 'redirect=%'").select("domain", "at", F.regexp_extract("word", r"[:=](.+)$", 1).alias("other"), "sign", F.col("word").startswith("redirect").alias("all"))
    out, level = ranges, ranges
    for _ in range(depth):
        inner = level.select(F.col("domain").alias("other"), F.col("at").alias("inner"), "low", "high", F.col("sign").alias("own"))
        met = links.join(inner, "other").where(F.col("all") | (F.col("own") == "+"))
        level = met.select("domain", F.concat(F.array("at"), "inner").alias("at"), "low", "high", F.when(F.col("all"), F.col("own")).otherwise(F.col("sign")).alias("sign"))
        out = out.unionByName(level)
    named = F.create_map(*(F.lit(x) for kv in RESULTS.items() for x in kv))
    return out.select("domain", "at", "low", "high", F.element_at(named, F.col("sign")).alias("result"))


def own_auth(mail: DataFrame, records: DataFrame) -> DataFrame:
    """(msg_id, spf, dkim, dmarc, auth_source) of mails with a sender domain, as the published records have it.

    SPF: the first range of the return path's (else sender's) record that holds
    the first public address of the hops; ``none`` without a record, null without
    an address. DKIM is ``none``: signatures aren't verified here. DMARC: ``none``
    without a policy of the domain or its registered domain, else ``pass`` where
    SPF passed for an aligned domain.
    """
    ips = F.filter(F.transform("received", lambda h: h["ip"]), lambda ip: ip.isNotNull() & ~F.coalesce(is_private_ip(ip), F.lit(False)))
    m = mail.where(F.coalesce("from.domain", F.lit("")) != "").select("msg_id", F.lower("from.domain").alias("sender"), F.lower(F.coalesce(F.nullif(F.col("return_path.domain"), F.lit("")), F.col("from.domain"))).alias("domain"), ip_number(F.get(ips, F.lit(0))).alias("ip"))
    terms = spf_terms(records)
    hit = m.where("ip IS NOT NULL").join(terms, "domain").where("ip BETWEEN low AND high").groupBy("msg_id").agg(F.min_by("result", "at").alias("spf"))
    has = terms.select("domain", F.lit(True).alias("has")).distinct()
    policy = records.where(F.lower("name").startswith("_dmarc.") & F.lower("txt").startswith("v=dmarc1")).groupBy(F.substring(F.lower("name"), 8, 255).alias("d")).agg(F.min("txt").alias("txt"))
    d = m.join(hit, "msg_id", "left").join(has, "domain", "left")
    d = d.withColumn("spf", F.when(F.col("ip").isNull(), None).when(F.col("has").isNull(), "none").otherwise(F.coalesce("spf", F.lit("neutral"))))
    d = d.withColumn("org", registrable_domain(F.col("sender"))).join(policy.select(F.col("d").alias("sender"), F.col("txt").alias("own")), "sender", "left").join(policy.select(F.col("d").alias("org"), F.col("txt").alias("above")), "org", "left")
    tags = dmarc_tags(F.coalesce("own", "above"))
    speaks = F.when(F.try_element_at(tags, F.lit("aspf")) == "s", aligned(F.col("sender"), F.col("domain"), True)).otherwise(aligned(F.col("sender"), F.col("domain")))
    passed = (F.coalesce("spf", F.lit("")) == "pass") & speaks
    return d.select("msg_id", "spf", F.lit("none").alias("dkim"), F.when(F.coalesce("own", "above").isNull(), "none").when(passed, "pass").otherwise("fail").alias("dmarc"), F.lit("own").alias("auth_source"))
