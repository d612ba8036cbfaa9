"""Requests to analyse something, and the line-delimited JSON that batches, labels and pilots come and go in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailquern.operators.evaluate import checked_examples

REQUEST = "text string, eml_base64 string, image_base64 string, lang string, no_llm boolean, submitted_by string, department string, channel string"
#: The largest message of a request, in bytes.
MAX_BYTES = 25 << 20


def analyse_requests(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, kind, content, lang, no_llm, submitted_by, department, channel, error) of request bodies in JSON.

    A message comes before an image, an image before a text. Bodies that are no
    JSON, hold no message, bad base64 or too much come out with an error and
    without content, as do null ones; the channel is ``api`` unless named.
    """
    r = F.from_json(F.col(body), REQUEST)
    d = df.select(F.col(key).alias(key), F.col(body).alias("__body"), r.alias("__r"))
    raw = lambda c: F.try_to_binary(F.regexp_replace(c, r"[\r\n]", ""), F.lit("base64"))
    held = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = F.when(held("__r.eml_base64"), "eml").when(held("__r.image_base64"), "image").when(F.trim(F.coalesce("__r.text", F.lit(""))) != "", "text")
    d = d.withColumn("kind", kind)
    d = d.withColumn("content", F.when(F.col("kind") == "eml", raw(F.col("__r.eml_base64"))).when(F.col("kind") == "image", raw(F.col("__r.image_base64"))).when(F.col("kind") == "text", F.encode("__r.text", "utf-8")))
    no_json = F.col("__body").isNull() | F.try_parse_json("__body").isNull() | ~F.trim("__body").startswith("{")
    error = F.when(no_json, "invalid JSON").when(F.col("kind").isNull(), "provide text, eml_base64 or image_base64").when(F.col("content").isNull(), F.concat("kind", F.lit("_base64 is not valid base64"))).when(F.octet_length("content") > MAX_BYTES, "above the size limit")
    fields = [F.coalesce("__r.no_llm", F.lit(False)).alias("no_llm"), F.coalesce(F.nullif(F.col("__r.channel"), F.lit("")), F.lit("api")).alias("channel")]
    d = d.withColumn("error", error)
    return d.select(key, "kind", F.when(F.col("error").isNull(), F.col("content")).alias("content"), F.col("__r.lang").alias("lang"), F.col("__r.submitted_by").alias("submitted_by"), F.col("__r.department").alias("department"), *fields, "error")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(target, signals) of labelled lines; blank lines are skipped, a bad line is an error that says what is wrong."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", "label string, signals map<string,double>", {"mode": "FAILFAST"})
    return checked_examples(lines.select(parsed.alias("r")).select(F.trim("r.label").alias("label"), "r.signals"))


def read_pilot(spark: SparkSession, path: str) -> DataFrame:
    """(id, predicted, actual, signals) of a pilot's lines; blank lines are skipped, lines that are no JSON an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", "id string, predicted string, actual string, signals map<string,double>", {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_results(analysed: DataFrame, path: str) -> None:
    """Batch results as a folder of JSON lines: file, verdict, score, attack_type, brand, signals, error. Fields without a value are left out."""
    known = set(analysed.columns)
    column = lambda c, kind: (F.col(c) if c in known else F.lit(None)).cast(kind).alias(c)
    brand = F.col("brand.name") if "brand" in known and analysed.schema["brand"].dataType.typeName() == "struct" else column("brand", "string")
    signals = F.transform("signals", lambda s: s["id"]) if "signals" in known and "struct" in analysed.schema["signals"].dataType.simpleString() else column("signals", "array<string>")
    analysed.select(F.col("msg_id").alias("file"), column("verdict", "string"), column("score", "int"), column("attack_type", "string"), brand.alias("brand"), signals.alias("signals"), column("error", "string")).write.json(path, ignoreNullFields=True)
