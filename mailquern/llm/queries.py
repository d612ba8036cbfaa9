"""The queries of this subpackage over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailquern.registry import Registry
from mailquern.tables import one_row_per_key, table

R = Registry()


# -- 1: text that looks the same --------------------------------------------------------------------------------------


def _domain_values(spark: SparkSession, sf: str) -> DataFrame:
    addr = table(spark, sf, "addresses").select(F.lit("addr_domain").alias("field_name"), F.col("addr_id").alias("id_b"), F.col("addr_domain").alias("value"))
    ev = table(spark, sf, "notify_events").select(F.lit("link_domains").alias("field_name"), F.col("event_no").alias("id_b"), F.explode("link_domains").alias("value"))
    return addr.unionByName(ev).where(F.col("value").isNotNull() & F.col("id_b").isNotNull())


@R.query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Domains that show a known domain's name, and pairs of bodies that look the same.

    Values meet by their canonical forms. ASCII domains are their own form but
    for blanks at the ends, so only the others are scanned; the known names, a
    stated table, are canonical by themselves and part of the vocabulary. Of
    bodies the distinct texts of one form are paired, and each pair then meets
    its rows: copies of one text cost nothing but the cases they are.
    """
    from .lookalike import canonical

    known = table(spark, sf, "known_domains").where(F.col("domain_name").isNotNull() & F.col("domain_id").isNotNull()).select("domain_id", "domain_name").distinct()
    values = _domain_values(spark, sf)
    odd = values.where(F.col("value").rlike(r"[^\x00-\x7f]")).unionByName(known.select(F.lit("known").alias("field_name"), F.col("domain_id").alias("id_b"), F.col("domain_name").alias("value")))
    forms = canonical(odd, ["field_name", "id_b", "value"], "value", all_texts=False, strip=True)
    names = forms.where("field_name = 'known'").select("form", F.col("id_b").alias("domain_id"), F.col("value").alias("domain_name"))
    seen = forms.where("field_name <> 'known'")
    blanks = r"^[\s]+|[\s]+$"
    ascii_names = known.where(~F.col("domain_name").rlike(r"[^\x00-\x7f]"))
    spaced = values.where(F.col("value").rlike(r"^[\x00-\x7f]*$") & F.col("value").rlike(blanks)).withColumn("domain_name", F.regexp_replace("value", blanks, ""))
    domains = seen.join(names, "form").where(F.col("value") != F.col("domain_name")).select("field_name", F.col("domain_id").alias("id_a"), "id_b").unionByName(spaced.join(ascii_names, "domain_name").select("field_name", F.col("domain_id").alias("id_a"), "id_b")).distinct()

    texts = table(spark, sf, "prompt_data").where(F.col("prompt_id").isNotNull()).withColumn("h", F.xxhash64("body", F.length("body")))
    bodies = canonical(texts, ["prompt_id", "h"], "body", all_texts=False).select("prompt_id", "h", "form").distinct()
    distinct = bodies.select("form", "h").distinct()
    several = distinct.groupBy("form").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where(F.col("lo") != F.col("hi")).select("form")
    variants = distinct.join(several, "form", "left_semi")
    pairs = variants.select("form", F.col("h").alias("ha")).join(variants.select("form", F.col("h").alias("hb")), "form").where("ha < hb")
    met = pairs.join(bodies.select("form", F.col("h").alias("ha"), F.col("prompt_id").alias("a")), ["form", "ha"]).join(bodies.select("form", F.col("h").alias("hb"), F.col("prompt_id").alias("b")), ["form", "hb"]).where("a <> b")
    return domains.unionByName(met.select(F.lit("body").alias("field_name"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct())


@R.query("p1_canonical")
def p1_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every mail body in its one written form."""
    from .lookalike import canonical

    return canonical(table(spark, sf, "prompt_data"), ["prompt_id"], "body").select("prompt_id", F.col("canonical").alias("body"))


# -- 2: items that appear together ------------------------------------------------------------------------------------

_P2_SQL = """
WITH baskets AS (
  SELECT source_table, list_distinct(list_filter(items, lambda x: x IS NOT NULL)) AS b FROM (
    SELECT 'notify_events' AS source_table, any_value(signals) AS items FROM notify_events GROUP BY event_no
    UNION ALL SELECT 'awareness_cards', any_value(signals) FROM awareness_cards GROUP BY card_id)
  WHERE len(list_filter(items, lambda x: x IS NOT NULL)) > 0),
totals AS (SELECT source_table, count(*) AS n FROM baskets GROUP BY 1),
ids AS (SELECT source_table, row_number() OVER () AS r, b FROM baskets),
single AS (SELECT source_table, r, unnest(b) AS s FROM ids),
c AS (SELECT source_table, s, count(*) AS c FROM single GROUP BY 1, 2),
p AS (SELECT x.source_table, x.s AS signal_a, y.s AS signal_b, count(*) AS n_both
      FROM single x JOIN single y ON x.r = y.r AND x.s < y.s GROUP BY 1, 2, 3)
SELECT p.source_table, p.signal_a, p.signal_b{extra} FROM p JOIN totals t USING (source_table)
JOIN c a ON a.source_table = p.source_table AND a.s = p.signal_a
JOIN c b ON b.source_table = p.source_table AND b.s = p.signal_b
{where}
"""
_P2_LEAST = "WHERE n_both >= 10 AND n_both >= 0.004 * n AND n_both * n / (a.c * b.c) >= 3"


def _signal_pairs(spark: SparkSession, sf: str, **least: float) -> DataFrame:
    from .cooccur import pair_association

    out = None
    for name, key in (("notify_events", "event_no"), ("awareness_cards", "card_id")):
        one = pair_association(table(spark, sf, name), "signals", key=key, **least).select(F.lit(name).alias("source_table"), F.col("item_a").alias("signal_a"), F.col("item_b").alias("signal_b"), "n_both", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))
        out = one if out is None else out.unionByName(one)
    return out


@R.query("p2_found", _P2_SQL.replace("{extra}", "").replace("{where}", _P2_LEAST))
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _signal_pairs(spark, sf).select("source_table", "signal_a", "signal_b")


@R.query("p2_association", _P2_SQL.replace("{extra}", ", n_both, round(n_both * n / (a.c * b.c), 6) AS lift, round(log2(n_both * n / (a.c * b.c)), 6) AS pmi").replace("{where}", ""))
def p2_association(spark: SparkSession, sf: str) -> DataFrame:
    """Every two signals that any record holds, with their count and how far it exceeds chance."""
    return _signal_pairs(spark, sf, min_count=1, min_share=0.0, min_lift=0.0)


# -- 3: most frequent items -------------------------------------------------------------------------------------------

_P3_SQL = r"""
WITH v AS (
  SELECT 'ioc_value' AS field_name, ioc_value AS x FROM iocs
  UNION ALL SELECT 'sender_domain', sender_domain FROM notify_events
  UNION ALL SELECT 'link_domains', unnest(link_domains) FROM notify_events),
t AS (SELECT field_name, lower(regexp_replace(x, '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) AS item FROM v WHERE x IS NOT NULL),
n AS (SELECT field_name, count(*) AS n_field FROM t WHERE item <> '' GROUP BY 1),
c AS (SELECT field_name, item, count(*) AS n FROM t WHERE item <> '' GROUP BY 1, 2)
SELECT field_name, item{extra} FROM c JOIN n USING (field_name) WHERE n >= 8 AND n >= 0.005 * n_field
"""


def _frequent(spark: SparkSession, sf: str) -> DataFrame:
    from .frequent import clean_item, heavy_hitters

    ev = table(spark, sf, "notify_events")
    values = (
        table(spark, sf, "iocs").select(F.lit("ioc_value").alias("field"), F.col("ioc_value").alias("item"))
        .unionByName(ev.select(F.lit("sender_domain").alias("field"), F.col("sender_domain").alias("item")))
        .unionByName(ev.select(F.lit("link_domains").alias("field"), F.explode("link_domains").alias("item")))
    )
    return heavy_hitters(values.select("field", clean_item(F.col("item")).alias("item"))).withColumnRenamed("field", "field_name")


@R.query("p3_found", _P3_SQL.replace("{extra}", ""))
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _frequent(spark, sf).select("field_name", "item")


@R.query("p3_counts", _P3_SQL.replace("{extra}", ", n"))
def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _frequent(spark, sf).select("field_name", "item", "n")


# -- 8: ids of a public tokenizer -------------------------------------------------------------------------------------


@R.query("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from .bpe import encode_texts

    return encode_texts(table(spark, sf, "documents"), "doc_id", "text")


# -- 9: evaluation passages in the corpus -----------------------------------------------------------------------------


@R.query("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from .leakage import leaked_items

    return leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage")


# -- 10: oversized texts in pieces ------------------------------------------------------------------------------------


@R.query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that the operator cuts."""
    return p10_pieces(spark, sf).where("piece_no = 1").select("doc_id").distinct()


@R.query("p10_pieces")
def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from .pieces import split_texts

    return split_texts(table(spark, sf, "documents"), "doc_id", "text")


# -- 6: text read in a wrong encoding ---------------------------------------------------------------------------------


def _subjects_and_bodies(spark: SparkSession, sf: str) -> DataFrame:
    subjects = one_row_per_key(table(spark, sf, "message_summaries").select("summary_id", "subject"), "summary_id")
    bodies = one_row_per_key(table(spark, sf, "prompt_data").select("prompt_id", "body"), "prompt_id")
    return subjects.select(F.lit("subject").alias("field_name"), F.col("summary_id").alias("record_id"), F.col("subject").alias("text")).unionByName(
        bodies.select(F.lit("body").alias("field_name"), F.col("prompt_id").alias("record_id"), F.col("body").alias("text"))
    )


@R.query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_restored(spark, sf).select("field_name", "record_id")


@R.query("p6_restored")
def p6_restored(spark: SparkSession, sf: str) -> DataFrame:
    from .garbled import find_garbled

    return find_garbled(_subjects_and_bodies(spark, sf), ["field_name", "record_id"], "text").select("field_name", "record_id", "restored", "undone")


# -- 5: what an e-mail's sender wrote anew ----------------------------------------------------------------------------


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    return one_row_per_key(table(spark, sf, "prompt_data").select("prompt_id", "body"), "prompt_id")


@R.query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from .authored import found_pieces

    return found_pieces(_bodies(spark, sf), "prompt_id", "body")


@R.query("p5_new_text")
def p5_new_text(spark: SparkSession, sf: str) -> DataFrame:
    from .authored import classified

    return classified(_bodies(spark, sf), "prompt_id", "body").select("prompt_id", "new_text")


# -- 7: personal details ----------------------------------------------------------------------------------------------


def _personal_texts(spark: SparkSession, sf: str) -> DataFrame:
    p = one_row_per_key(table(spark, sf, "prompt_data").select("prompt_id", "body", "mail_from"), "prompt_id")
    fields = F.explode(F.array(F.struct(F.lit("body").alias("field_name"), F.col("body").alias("text")), F.struct(F.lit("mail_from").alias("field_name"), F.col("mail_from").alias("text")))).alias("f")
    subjects = one_row_per_key(table(spark, sf, "message_summaries").select("summary_id", "subject"), "summary_id")
    return p.select(F.col("prompt_id").alias("record_id"), fields).select("f.field_name", "record_id", "f.text").unionByName(subjects.select(F.lit("subject").alias("field_name"), F.col("summary_id").alias("record_id"), F.col("subject").alias("text")))


@R.query("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from .pii import disclosing_terms, found_details, known_terms

    texts = _personal_texts(spark, sf)
    terms, shapes = disclosing_terms(texts, "text", known_terms(table(spark, sf, "staff"), "first_name", "last_name"))
    return found_details(texts, ["field_name", "record_id"], "text", terms, shapes)


@R.query("p7_redacted")
def p7_redacted(spark: SparkSession, sf: str) -> DataFrame:
    from .pii import disclosing_terms, known_terms, redacted

    texts = _personal_texts(spark, sf)
    terms, shapes = disclosing_terms(texts, "text", known_terms(table(spark, sf, "staff"), "first_name", "last_name"))
    return redacted(texts, ["field_name", "record_id"], "text", terms, shapes)
