"""Column functions over hosts, addresses and URLs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from mailquern import refdata
from mailquern.functions.text import strings


def address_of(c: Column) -> Column:
    """The address of a From value, in lower case; null if it has none."""
    inner = F.regexp_extract(c, r"<([^<>\s]+@[^<>\s]+)>", 1)
    bare = F.regexp_extract(c, r"([^\s<>()\"',;]+@[^\s<>()\"',;]+)", 1)
    return F.lower(F.nullif(F.when(inner != "", inner).otherwise(bare), F.lit("")))


def display_of(c: Column) -> Column:
    """The display name of a From value; null if there is none."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^<>]*>\s*$", ""), r"^\s*\"|\"\s*$", "")), F.lit(""))


def domain_of(address: Column) -> Column:
    return F.when(F.contains(address, F.lit("@")), F.lower(F.substring_index(address, "@", -1)))


def canonical_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\.+$", "")


def url_host(url: Column) -> Column:
    """The host of a URL without user, port and final dot, in lower case; empty if there is none."""
    return canonical_host(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def url_port(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)", 1)


def labels(host: Column) -> Column:
    return F.filter(F.split(host, "[._-]"), lambda x: x != "")


def tld(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1)).otherwise("")


def registrable_domain(host: Column, second_level: Sequence[str] = tuple(refdata.SECOND_LEVEL)) -> Column:
    """The part of a host that is registered: its last two labels, or three below a second-level label.

    A rule in place of the public suffix list, wholly in expressions;
    ``psl_registrable_domain`` follows the list where a copy is at hand.
    """
    n = F.size(F.split(host, r"\."))
    below = (n >= 3) & F.substring_index(F.substring_index(host, ".", -2), ".", 1).isin(list(second_level))
    return F.when(host.isNull() | (n < 3), host).when(below, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


@cache
def _suffixes(path: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    rules = [x.split()[0] for x in open(path, encoding="utf-8") if x.strip() and not x.startswith("//")]
    return frozenset(r for r in rules if r[0] not in "*!"), frozenset(r[2:] for r in rules if r.startswith("*.")), frozenset(r[1:] for r in rules if r[0] == "!")


def _registrable(host: str, path: str) -> str:
    plain, wild, exceptions = _suffixes(path)
    parts = host.split(".")
    for i in range(len(parts)):
        rest = ".".join(parts[i:])
        if rest in exceptions:
            return rest
        if rest in plain or ".".join(parts[i + 1 :]) in wild or i == len(parts) - 1:
            return ".".join(parts[i - 1 :]) if i else host
    return host


def psl_registrable_domain(path: str):
    """A function of a host column by the rules of a public suffix list file, private ones included."""

    @F.pandas_udf(StringType())
    def registrable(hosts: pd.Series) -> pd.Series:
        known = {h: _registrable(h, path) for h in hosts.dropna().unique()}
        return hosts.map(known)

    return registrable


def same_registrable(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (registrable_domain(a) == registrable_domain(b)), F.lit(False))


def is_ipv4(host: Column) -> Column:
    return F.coalesce(host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), F.lit(False))


def is_private_ip(ip: Column) -> Column:
    """Private, loopback, link-local, multicast, unspecified and metadata addresses of both families."""
    v4 = F.when(is_ipv4(ip), F.transform(F.split(ip, r"\."), lambda x: x.cast("int")))
    a, b = F.get(v4, F.lit(0)), F.get(v4, F.lit(1))
    own4 = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | a.between(224, 239)
    own6 = F.lower(ip).rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)$")
    return F.coalesce(own4, own6 & F.contains(ip, F.lit(":")), F.lit(False))


def reverse_ip(ip: Column) -> Column:
    """The name under which a DNS list holds an IPv4 address."""
    return F.when(is_ipv4(ip), F.concat_ws(".", F.reverse(F.split(ip, r"\."))))


def is_shortener(host: Column) -> Column:
    return F.coalesce(F.array_contains(strings(refdata.SHORTENERS), host) | F.array_contains(strings(refdata.SHORTENERS), registrable_domain(host)), F.lit(False))


def punycode(host: Column) -> Column:
    return F.coalesce(F.contains(host, F.lit("xn--")), F.lit(False))


def host_from_text(anchor: Column) -> Column:
    """The host that an anchor's text shows, empty if it shows none."""
    t = F.trim(anchor)
    bare = F.when(t.rlike(r"^(?i)(?:[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?\.)+[\p{L}]{2,}(?:[:/?#]\S*)?$"), canonical_host(F.regexp_extract(t, r"^([^:/?#]+)", 1)))
    return F.coalesce(F.when(~t.rlike(r"\s"), F.coalesce(F.nullif(url_host(t), F.lit("")), bare)), F.lit(""))


def anchor_mismatch(anchor: Column, host: Column) -> Column:
    shown = host_from_text(anchor)
    return F.coalesce((shown != "") & (host != "") & ~same_registrable(shown, host), F.lit(False))


def distinct_hosts(*arrays: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(a, strings([])) for a in arrays)), lambda h: h.isNotNull() & (h != "")))


def aligned(from_domain: Column, auth_domain: Column, strict: bool = False) -> Column:
    """Whether an authenticated domain speaks for a From domain; relaxed alignment takes either as the other's parent."""
    if strict:
        return F.coalesce(from_domain == auth_domain, F.lit(False))
    return F.coalesce((from_domain == auth_domain) | from_domain.endswith(F.concat(F.lit("."), auth_domain)) | auth_domain.endswith(F.concat(F.lit("."), from_domain)), F.lit(False))


def dmarc_tags(record: Column) -> Column:
    """A policy record as a map of its tags."""
    pairs = F.filter(F.transform(F.split(record, ";"), F.trim), lambda x: F.contains(x, F.lit("=")))
    entries = F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^=]*=", "")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), 1)["v"]))


def _shown(host: str | None) -> str | None:
    out = []
    for label in (host or "").split("."):
        try:
            out.append(label[4:].encode("ascii").decode("punycode") if label.lower().startswith("xn--") else label)
        except UnicodeError:
            return None
    return ".".join(out) if host is not None else None


def unicode_host(host: Column | str) -> Column:
    """A host with its punycode labels as the letters they stand for; null where one can't be decoded."""
    import pandas as pd
    from pyspark.sql.types import StringType

    def run(hosts: pd.Series) -> pd.Series:
        return hosts.map(_shown)

    run.__annotations__ = {"hosts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())(host)
