"""What language models answered: parsed, checked and put in place; and the texts sent to them made safe."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mailquern import refdata

ANSWER = "verdict_opinion string, attack_type string, summary string, recommended_action string, tactics array<string>, highlights array<struct<text:string,reason:string>>, questions array<string>"
TACTICS = ["urgency", "authority", "fear", "greed", "curiosity", "scarcity", "impersonation", "trust"]


def parsed_opinions(df: DataFrame, text: str, tactics: list[str] = TACTICS) -> DataFrame:
    """``df`` with ``opinion``: the first JSON object of an answer, null where it doesn't hold to the form.

    The verdict must be known, the summary not empty and the attack type known
    (none if missing). Unknown tactics go; long parts are cut: the summary at
    1,200 characters, the action at 400, highlights at 8 and questions at 6.
    """
    o = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), ANSWER)
    d = df.withColumn("__o", o)
    attack = F.coalesce("__o.attack_type", F.lit("none"))
    valid = F.col("__o.verdict_opinion").isin("phishing", "suspicious", "clean") & attack.isin(refdata.ATTACK_TYPES) & (F.trim("__o.summary") != "")
    kept = F.struct(
        F.col("__o.verdict_opinion").alias("verdict_opinion"), attack.alias("attack_type"), F.left("__o.summary", F.lit(1200)).alias("summary"), F.left("__o.recommended_action", F.lit(400)).alias("recommended_action"),
        F.filter("__o.tactics", lambda t: t.isin(tactics)).alias("tactics"), F.slice("__o.highlights", 1, 8).alias("highlights"), F.slice("__o.questions", 1, 6).alias("questions"),
    )
    return d.withColumn("opinion", F.when(F.coalesce(valid, F.lit(False)), kept)).drop("__o")


def first_valid(attempts: DataFrame, key: str, order: str, opinion: str = "opinion") -> DataFrame:
    """(key, opinion): of several providers' answers the first valid one."""
    return attempts.where(F.col(opinion).isNotNull()).groupBy(key).agg(F.min_by(opinion, order).alias(opinion))


def explain_key(version: str, language: Column, text: Column, hosts: Column) -> Column:
    """The key under which an answer is kept: version, language, text without extra blanks, and link hosts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(version), language, F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), F.array_join(F.array_sort(F.coalesce(hosts, F.array().cast("array<string>"))), ",")), 256)


#: What is redacted, in this order; word ends are those of ASCII.
KINDS = (
    ("EMAIL", re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", re.A)),
    ("IBAN", re.compile(r"\b[A-Z]{2}\d{2}[A-Z0-9]{12,30}\b", re.A)),
    ("CARD", re.compile(r"\b(?:\d[ \-]?){13,19}\b", re.A)),
    ("IIN", re.compile(r"\b\d{12}\b", re.A)),
    ("PHONE", re.compile(r"(?:\+?[78]|\+\d{1,3})[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b", re.A)),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return 13 <= len(digits) <= 19 and total % 10 == 0


def redact(text: str | None) -> str | None:
    """A text with addresses, accounts, cards, identity and phone numbers replaced by numbered placeholders of their kind.

    The same original, letter for letter, has the same number within a text; an
    e-mail's domain stays behind its placeholder.
    """
    if text is None:
        return None
    for kind, form in KINDS:
        seen: dict[str, int] = {}

        def put(m: re.Match, kind: str = kind, seen: dict[str, int] = seen) -> str:
            raw = m.group()
            if kind == "CARD" and not luhn(re.sub(r"\D", "", raw)):
                return raw
            n = seen.setdefault(raw, len(seen) + 1)
            return f"[{kind}_{n}]{raw[raw.rindex('@') :]}" if kind == "EMAIL" else f"[{kind}_{n}]"

        text = form.sub(put, text)
    return text


def redacted(df: DataFrame, text: str, to: str = "redacted") -> DataFrame:
    """``df`` with ``to``: the text made safe to send; a placeholder's number is a state of the text, hence Arrow and not expressions."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{to}` string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{to: [redact(t) for t in pdf[text]]})

    return df.mapInPandas(run, schema)


def redaction_counts(text: Column) -> Column:
    """How many e-mail addresses and twelve-digit numbers a text holds, by expressions only."""
    return F.struct(F.regexp_count(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")).alias("emails"), F.regexp_count(text, F.lit(r"(?<![0-9])[0-9]{12}(?![0-9])")).alias("identifiers"))
