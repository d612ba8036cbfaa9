"""Joins of mails with what other systems know: lists, feeds, registration dates, opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailquern.functions.hosts import canonical_host, distinct_hosts, registrable_domain, unicode_host, url_host
from mailquern.model import OPINION


def candidates(mail: DataFrame) -> DataFrame:
    """(msg_id, org_id, role, at, value): addresses, hosts and registrable domains of each mail that lists may name."""
    sender = F.array(F.col("from.addr"), F.col("from.domain"), registrable_domain(F.col("from.domain")))
    others = F.concat(F.array(F.col("reply_to.addr"), F.col("reply_to.domain"), registrable_domain(F.col("reply_to.domain"))), F.flatten(F.transform("links", lambda x: F.array(x["domain"], registrable_domain(x["domain"])))))
    one = lambda role, values: mail.select("msg_id", "org_id", F.lit(role).alias("role"), F.posexplode(values).alias("at", "value"))
    return one("sender", sender).unionByName(one("other", others)).where("value IS NOT NULL AND value <> ''")


def list_hits(mail: DataFrame, entries: DataFrame) -> DataFrame:
    """(msg_id, block_hit, allow_hit): the first blocked and the first allowed value of each mail.

    ``entries`` has org_id, kind (block or allow) and value; an empty org_id
    holds for all organisations. Any of a mail's values may be blocked, only its
    sender's allowed.
    """
    e = entries.select(F.col("org_id").alias("list_org"), "kind", canonical_host(F.col("value")).alias("value")).distinct()
    hit = candidates(mail).join(e, "value").where((F.col("list_org") == "") | (F.col("list_org") == F.col("org_id"))).where((F.col("kind") == "block") | (F.col("role") == "sender"))
    order = F.struct(F.col("role") != "sender", "at")
    return hit.groupBy("msg_id").agg(F.min_by("value", F.when(F.col("kind") == "block", order)).alias("block_hit"), F.min_by("value", F.when(F.col("kind") == "allow", order)).alias("allow_hit"))


def feed_hosts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(host): the distinct hosts of a feed of URLs, one a line; comments and blanks left out."""
    url = F.trim(column)
    return lines.where((url != "") & ~url.startswith("#")).select(url_host(url).alias("host")).where("host <> ''").distinct()


def listed_domains(mail: DataFrame, feeds: DataFrame) -> DataFrame:
    """(msg_id, listed_domains): hosts of a mail that a feed names. ``feeds``: host, source, priority; the first source counts."""
    hosts = mail.select("msg_id", F.explode(distinct_hosts(F.array("from.domain"), F.transform("links", lambda x: x["domain"]))).alias("host"))
    first = feeds.groupBy(canonical_host(F.col("host")).alias("host")).agg(F.min_by("source", "priority").alias("source"))
    return hosts.join(first, "host").groupBy("msg_id").agg(F.array_sort(F.collect_set("host")).alias("listed_domains"))


def dns_listed(answer: Column) -> Column:
    """Whether a DNS list's answer names the address as listed; 127.255.* are errors."""
    return F.coalesce(answer.startswith("127.") & ~answer.startswith("127.255."), F.lit(False))


def listed_ips(mail: DataFrame, answers: DataFrame) -> DataFrame:
    """(msg_id, listed_ips): hop addresses that a DNS list holds or that abuse reports score at 50 or more.

    ``answers``: ip, answer, abuse_score.
    """
    ips = mail.select("msg_id", F.explode(F.array_distinct(F.transform("received", lambda x: x["ip"]))).alias("ip")).where("ip IS NOT NULL")
    bad = answers.where(dns_listed(F.col("answer")) | (F.coalesce("abuse_score", F.lit(0)) >= 50)).select("ip").distinct()
    return ips.join(bad, "ip").groupBy("msg_id").agg(F.collect_set("ip").alias("listed_ips"))


def registration_dates(responses: DataFrame) -> DataFrame:
    """(domain, registered_at) of registration records in JSON: the first ``registration`` event."""
    parsed = F.from_json("body", "events array<struct<eventAction:string,eventDate:string>>")
    first = F.get(F.filter(parsed["events"], lambda e: e["eventAction"] == "registration"), F.lit(0))
    return responses.select("domain", F.try_to_timestamp(first["eventDate"]).alias("registered_at")).where("registered_at IS NOT NULL")


def urlhaus_listed(body: Column) -> Column:
    """Whether an answer lists its host; null where the answer is none or says neither."""
    r = F.from_json(body, "query_status string, urls array<string>")
    return F.when(r["query_status"] == "no_results", False).when(r["query_status"] == "ok", F.coalesce(F.size(r["urls"]), F.lit(0)) > 0)


def safebrowsing_listed(body: Column) -> Column:
    """Whether an answer has matches; null where it is no JSON object."""
    return F.when(F.try_parse_json(body).isNotNull() & F.trim(body).startswith("{"), F.coalesce(F.json_array_length(F.get_json_object(body, "$.matches")), F.lit(0)) > 0)


def virustotal_listed(body: Column, http_status: Column | None = None) -> Column:
    """Whether a file's last analysis found it malicious or suspicious; an unknown file (404) isn't listed, other failures say nothing."""
    stats = F.from_json(body, "data struct<attributes struct<last_analysis_stats struct<malicious:int,suspicious:int>>>".replace(" struct", ":struct").replace("data:", "data "))["data"]["attributes"]["last_analysis_stats"]
    told = F.when(F.try_parse_json(body).isNotNull(), (F.coalesce(stats["malicious"], F.lit(0)) > 0) | (F.coalesce(stats["suspicious"], F.lit(0)) > 0))
    return told if http_status is None else F.when(http_status == 404, False).when(F.floor(http_status / 100) == 2, told)


def unicode_senders(mail: DataFrame) -> DataFrame:
    """(msg_id, from_unicode): senders' domains in punycode as they are shown. Distinct hosts are decoded once."""
    own = mail.select("msg_id", F.col("from.domain").alias("host")).where(F.contains("host", F.lit("xn--")))
    return own.join(own.select("host").distinct().withColumn("from_unicode", unicode_host("host")), "host").select("msg_id", "from_unicode")


def with_lookups(mail: DataFrame, **tables: DataFrame) -> DataFrame:
    """``mail`` with the lookup columns of the tables given: lists, feeds, dns, registrations, hashes, logins, opinions, brands; with ``senders`` punycode is decoded.

    Each lookup is made of the few columns it needs and joined to the message
    ids alone; the records themselves, with their bodies, meet the result in one
    join at the end. Message ids are unique.
    """
    found = []
    if "lists" in tables:
        found.append(list_hits(mail, tables["lists"]))
    if "feeds" in tables:
        found.append(listed_domains(mail, tables["feeds"]))
    if "dns" in tables:
        found.append(listed_ips(mail, tables["dns"]))
    if "registrations" in tables:
        r = tables["registrations"].select(F.col("domain").alias("__domain"), "registered_at")
        own = mail.select("msg_id", registrable_domain(F.col("from.domain")).alias("__domain")).where(F.col("__domain").isNotNull())
        found.append(own.join(r, "__domain").select("msg_id", "registered_at"))
    if "hashes" in tables:
        bad = tables["hashes"].where("malicious > 0 OR suspicious > 0").select("sha256").distinct()
        own = mail.select("msg_id", F.explode(F.transform("attachments", lambda x: x["sha256"])).alias("sha256")).join(bad, "sha256")
        found.append(own.groupBy("msg_id").agg(F.collect_set("sha256").alias("listed_hashes")))
    if "logins" in tables:
        forms = tables["logins"].where("has_login_form").select(F.col("url").alias("href")).distinct()
        own = mail.select("msg_id", F.posexplode(F.transform("links", lambda x: x["href"])).alias("at", "href")).join(forms, "href")
        found.append(own.groupBy("msg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "href"))), lambda x: x["href"]).alias("login_forms")))
    if "opinions" in tables:
        found.append(tables["opinions"].select("msg_id", F.col("llm").cast(OPINION).alias("llm")))
    if "senders" in tables:
        found.append(unicode_senders(mail))
    if "brands" in tables:
        from mailquern.operators.brands import shown_brands

        found.append(shown_brands(mail, tables["brands"]))
    if not found:
        return mail
    narrow = found[0]
    for other in found[1:]:
        narrow = narrow.join(other, "msg_id", "full")
    return mail.drop(*(c for c in narrow.columns if c != "msg_id")).join(narrow, "msg_id", "left")
