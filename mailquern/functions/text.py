"""Column functions over text. Patterns follow RE2: ASCII ``\\w``, case folding over all of Unicode."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from mailquern import refdata

SPACE = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive search; Java needs the Unicode flag to fold letters beyond ASCII."""
    return F.coalesce(c, F.lit("")).rlike(f"(?iu){pattern}")


def norm_text(subject: Column, text: Column) -> Column:
    return F.replace(F.lower(F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))), F.lit("ё"), F.lit("е"))


def strings(values: Sequence[str]) -> Column:
    """An array of fixed strings; one literal that the optimizer unfolds, since hundreds are slow to plan."""
    return F.split(F.lit("\x1f".join(values)), "\x1f") if values else F.array().cast("array<string>")


def lookup_map(values: dict[str, float]) -> Column:
    """A map of fixed numbers, as one literal."""
    return F.from_json(F.lit(json.dumps({k: float(v) for k, v in values.items()})), "map<string,double>")


def match_all(text: Column, words: Sequence[str], limit: int) -> Column:
    """The first ``limit`` distinct dictionary entries that the normalised text holds, in dictionary order."""
    own = list(dict.fromkeys(w.replace("ё", "е") for w in words))
    return F.slice(F.filter(strings(own), lambda w: F.contains(text, w)), 1, limit)


def any_of(text: Column, words: Sequence[str]) -> Column:
    return F.exists(strings(words), lambda w: F.contains(text, w))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda x: x != ""))


def density(hits: Column, text: Column) -> Column:
    """0.5 and a quarter of the hits per hundred words, of twenty words at least; no more than 1."""
    return F.least(F.lit(1.0), F.lit(0.5) + hits * 100.0 / F.greatest(word_count(text), F.lit(20)) * 0.25)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def last_lines(c: Column, n: int = 6) -> Column:
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), F.trim), lambda x: x != "")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), n), "\n")


def detect_language(c: Column) -> Column:
    """kz, ru, en or empty, by letters of the Kazakh, Cyrillic and Latin alphabets."""
    only = lambda text, cls: F.regexp_replace(text, f"[^{cls}]+", "")  # noqa: E731 - whole runs go at once
    text = F.coalesce(c, F.lit(""))
    cyrillic = only(text, r"\p{IsCyrillic}")
    kz, cyr, lat = F.length(only(cyrillic, "әіңғүұқөһӘІҢҒҮҰҚӨҺ")), F.length(cyrillic), F.length(only(text, r"\p{IsLatin}"))
    return F.when((kz > 0) & (kz * 40 >= cyr), "kz").when((cyr > 0) & (cyr >= lat), "ru").when(lat > 0, "en").otherwise("")


def round_half_up(c: Column) -> Column:
    """To whole numbers, halves away from zero."""
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


def digits_of(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: x.cast("int"))


def valid_kz_identifier(s: Column) -> Column:
    """Twelve digits with the check digit of an individual's or a company's number, not all zero."""
    d = digits_of(s)
    total = lambda ws: F.aggregate(F.zip_with(F.slice(d, 1, 11), F.array(*map(F.lit, ws)), lambda x, w: x * w), F.lit(0), lambda a, x: a + x) % 11
    first = total(range(1, 12))
    check = F.when(first == 10, total((3, 4, 5, 6, 7, 8, 9, 10, 11, 1, 2))).otherwise(first)
    return F.coalesce(s.rlike(r"^\d{12}$") & ~s.rlike("^0+$") & (F.when(s.rlike(r"^\d{12}$"), check == F.element_at(d, 12)).otherwise(False)), F.lit(False))


def kz_identifiers(text: Column) -> Column:
    """All valid twelve-digit numbers of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z_])(\d{12})(?![0-9A-Za-z_])"), F.lit(1))
    return F.filter(found, valid_kz_identifier)


def luhn_ok(s: Column) -> Column:
    """Whether 13 to 19 digits pass the check of payment cards."""
    d = F.reverse(digits_of(s))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.coalesce(s.rlike(r"^\d{13,19}$") & (F.when(s.rlike(r"^\d{13,19}$"), F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)), F.lit(False))


def extract_urls(text: Column) -> Column:
    """Distinct URLs of a text in order, without punctuation at their ends."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)((?:https?://|www\.)[^\s<>\"']+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?)\]}]+$", "")))


def normalise_homoglyphs(c: Column) -> Column:
    return F.translate(F.lower(c), "".join(refdata.HOMOGLYPHS), "".join(refdata.HOMOGLYPHS.values()))


def mixed_script(c: Column) -> Column:
    """Latin letters beside Cyrillic or other ones."""
    return F.coalesce(c.rlike(r"\p{IsLatin}") & c.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), F.lit(False))


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration such as ``1h30m``, ``250ms`` or ``7d``; empty and ``0`` are 0, what is none of these is null."""
    t = F.trim(text)
    units = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
    named = F.create_map(*(F.lit(x) for kv in units.items() for x in kv))
    parts = F.regexp_extract_all(t, F.lit(r"((?:\d+\.?\d*|\.\d+)(?:ms|us|µs|ns|h|m|s))"), F.lit(1))
    value = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.regexp_extract(p, r"^([\d.]+)", 1).cast("double") * F.element_at(named, F.regexp_extract(p, r"([a-zµ]+)$", 1)))
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    return F.when(t.isin("", "0"), 0.0).when(t.rlike(r"^[+-]?\d+d$"), F.regexp_extract(t, r"^([+-]?\d+)d$", 1).cast("double") * 86400).when(t.rlike(r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:ms|us|µs|ns|h|m|s))+$"), sign * value)


def language_tag(tag: Column, default: str = "ru") -> Column:
    """A language tag as one of ru, en and kz; kk is kz, others are the default."""
    main = F.regexp_extract(F.lower(F.trim(tag)), r"^([^-_]+)", 1)
    return F.when(main.isin("ru", "en", "kz"), main).when(main == "kk", "kz").otherwise(default)


def message(catalog: dict[str, dict[str, str]], language: Column, key: Column, default: str = "ru") -> Column:
    """The text of a key in a language's catalogue, else in the default one's, else in the English one's, else the key."""
    table = lambda lang: F.create_map(*(F.lit(x) for kv in (catalog.get(lang) or {"": ""}).items() for x in kv))
    own = F.coalesce(*(F.when(language_tag(language, default) == lang, F.try_element_at(table(lang), key)) for lang in catalog)) if catalog else F.lit(None).cast("string")
    return F.coalesce(own, F.try_element_at(table(default), key), F.try_element_at(table("en"), key), key)
