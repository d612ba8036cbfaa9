"""The core's queries over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailquern import refdata
from mailquern.functions import hosts as H, text as T
from mailquern.operators import analytics as A, brands as B, checks as C, evaluate as E, export as X, lookups as L, opinions as O, score as S
from mailquern.plans import views as V
from mailquern.registry import Registry
from mailquern.session import checkpointed
from mailquern.tables import table

R = Registry()
W = V.MAIL_SQL


# -- scalar functions -------------------------------------------------------------------------------------------------


@R.query("fn_hosts", rf"""WITH h AS (SELECT DISTINCT lower(addr_domain) AS host FROM addresses WHERE addr_domain IS NOT NULL)
SELECT host, CASE WHEN contains(host, '.') THEN string_split(host, '.')[-1] ELSE '' END AS tld, {V.registrable_sql('host')} AS registrable,
len(list_filter(regexp_split_to_array(host, '[._-]'), lambda x: x <> '')) AS n_labels, contains(host, 'xn--') AS punycode FROM h""")
def fn_hosts(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "addresses").where("addr_domain IS NOT NULL").select(F.lower("addr_domain").alias("host")).distinct()
    c = F.col("host")
    return h.select("host", H.tld(c).alias("tld"), H.registrable_domain(c).alias("registrable"), F.size(H.labels(c)).alias("n_labels"), H.punycode(c).alias("punycode"))


@R.query("fn_url", r"""SELECT DISTINCT ioc_value AS url, lower(regexp_extract(ioc_value, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)) AS host, regexp_extract(ioc_value, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]*:([0-9]+)', 1) AS port
FROM iocs WHERE ioc_kind = 'url' AND regexp_matches(ioc_value, '^[A-Za-z]')""")
def fn_url(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "iocs").where((F.col("ioc_kind") == "url") & F.col("ioc_value").rlike("^[A-Za-z]")).select(F.col("ioc_value").alias("url")).distinct()
    return u.select("url", H.url_host(F.col("url")).alias("host"), H.url_port(F.col("url")).alias("port"))


@R.query("fn_private_ip", r"""SELECT hop_id, (regexp_matches(ip, '^(10|127|0)\.') OR regexp_matches(ip, '^192\.168\.') OR regexp_matches(ip, '^169\.254\.') OR regexp_matches(ip, '^172\.(1[6-9]|2[0-9]|3[01])\.') OR regexp_matches(ip, '^2(2[4-9]|3[0-9])\.')) AS private
FROM (SELECT DISTINCT hop_id, ip FROM received_hops WHERE ip IS NOT NULL)""")
def fn_private_ip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "received_hops").where("ip IS NOT NULL").select("hop_id", "ip").distinct().select("hop_id", H.is_private_ip(F.col("ip")).alias("private"))


_KZ, _CYR, _LAT = "[^әіңғүұқөһӘІҢҒҮҰҚӨҺ]", r"[^\p{Cyrillic}]", r"[^\p{Latin}]"


@R.query("fn_language", rf"""WITH d AS (SELECT doc_id, length(regexp_replace(text, '{_KZ}', '', 'g')) AS kz, length(regexp_replace(text, '{_CYR}', '', 'g')) AS cyr, length(regexp_replace(text, '{_LAT}', '', 'g')) AS lat FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN kz > 0 AND kz * 40 >= cyr THEN 'kz' WHEN cyr > 0 AND cyr >= lat THEN 'ru' WHEN lat > 0 THEN 'en' ELSE '' END AS language FROM d""")
def fn_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.detect_language(F.col("text")).alias("language"))


@R.query("fn_keywords", "WITH d AS (SELECT doc_id, replace(lower(chr(10) || text), 'ё', 'е') AS t FROM documents WHERE text IS NOT NULL)\nSELECT doc_id, " + ", ".join(f"least(len(list_filter({V.list_sql(dict.fromkeys(w.replace('ё', 'е') for w in ws))}, lambda w: contains(t, w))), 5) AS {k}" for k, ws in refdata.KEYWORDS.items()) + " FROM d")
def fn_keywords(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.norm_text(F.lit(""), F.col("text")).alias("t"))
    return d.select("doc_id", *(F.size(T.match_all(F.col("t"), ws, 5)).alias(k) for k, ws in refdata.KEYWORDS.items()))


@R.query("fn_kz_identifiers", r"""WITH x AS (SELECT prompt_id, unnest(regexp_extract_all(body, '(?:^|[^0-9A-Za-z_])([0-9]{12})\b', 1)) AS n FROM (SELECT DISTINCT prompt_id, body FROM prompt_data WHERE body IS NOT NULL)),
d AS (SELECT prompt_id, n, list_transform(range(1, 13), lambda i: CAST(n[i] AS INTEGER)) AS d FROM x),
c AS (SELECT *, list_sum(list_transform(range(1, 12), lambda i: d[i] * i)) % 11 AS a, list_sum(list_transform(range(1, 12), lambda i: d[i] * CASE WHEN i <= 9 THEN i + 2 ELSE i - 9 END)) % 11 AS b FROM d)
SELECT prompt_id, n AS identifier, count(*) AS times FROM c WHERE (CASE WHEN a = 10 THEN b ELSE a END) = d[12] AND n <> '000000000000' GROUP BY 1, 2""")
def fn_kz_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "prompt_data").where("body IS NOT NULL").dropDuplicates(["prompt_id"]).select("prompt_id", F.explode(T.kz_identifiers(F.col("body"))).alias("identifier"))
    return d.groupBy("prompt_id", "identifier").agg(F.count("*").alias("times"))


@R.query("fn_homoglyphs", "SELECT DISTINCT addr_domain AS host, translate(lower(addr_domain), '" + "".join(refdata.HOMOGLYPHS) + "', '" + "".join(refdata.HOMOGLYPHS.values()) + r"') AS folded, (regexp_matches(addr_domain, '\p{Latin}') AND regexp_matches(regexp_replace(addr_domain, '\p{Latin}', '', 'g'), '\p{L}')) AS mixed FROM addresses WHERE addr_domain IS NOT NULL")
def fn_homoglyphs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "addresses").where("addr_domain IS NOT NULL").select(F.col("addr_domain").alias("host")).distinct()
    return d.select("host", T.normalise_homoglyphs(F.col("host")).alias("folded"), T.mixed_script(F.col("host")).alias("mixed"))


@R.query("fn_osa_distance")
def fn_osa_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's name against the registered label of each host of its length, give or take two."""
    hosts = table(spark, sf, "addresses").where("addr_domain IS NOT NULL").select(F.get(F.split(H.registrable_domain(F.lower("addr_domain")), r"\."), F.lit(0)).alias("label")).distinct()
    names = V.brands(spark, sf).select("name")
    near = hosts.withColumn("n", F.length("label")).join(names.withColumn("n", F.explode(F.sequence(F.length("name") - 1, F.length("name") + 1))), "n")
    return near.select("name", "label", B.osa(F.col("name"), F.col("label")).alias("distance")).where("distance <= 2")


@R.query("fn_urls", r"""SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:https?://|www\.)[^\s<>"'']+'), lambda x: regexp_replace(x, '[.,;:!?)\]}]+$', ''))).len() AS n_urls FROM documents WHERE text IS NOT NULL""")
def fn_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.extract_urls(F.col("text"))).cast("long").alias("n_urls"))


# -- checks -----------------------------------------------------------------------------------------------------------

_CHECK_SQL: dict[str, str] = {}
_REG = lambda a, b: f"coalesce({a} <> '' AND {b} <> '' AND {V.registrable_sql(a)} = {V.registrable_sql(b)}, false)"
_DENS = lambda n, t="norm": f"least(1.0, 0.5 + {n} * 100.0 / greatest({V.words_sql(t)}, 20) * 0.25)"


def _one(where: str, confidence: str) -> str:
    return f"WITH {W} SELECT msg_id, round(CAST({confidence} AS DOUBLE), 6) AS confidence FROM mail WHERE {where}"


def _kw(kind: str, most: int) -> str:
    words = V.list_sql(dict.fromkeys(w.replace("ё", "е") for w in refdata.KEYWORDS[kind]))
    return f"least(len(list_filter({words}, lambda w: contains(norm, w))), {most})"


for _k in ("urgency", "threat"):
    _CHECK_SQL[f"content.{_k}"] = _one(f"{_kw(_k, 5)} > 0", _DENS(_kw(_k, 5)))
_CHECK_SQL["content.credential_request"] = _one(f"{_kw('credential', 5)} > 0", _DENS(_kw("credential", 5)))
_CHECK_SQL["content.sms_code_request"] = _one(f"regexp_matches(norm, '(?i){refdata.PATTERNS['sms_code']}')", "0.85")
_CHECK_SQL["content.card_data_request"] = _one(f"regexp_matches(norm, '(?i){refdata.PATTERNS['card_data']}')", "0.8")
_CHECK_SQL["content.bank_detail_change"] = _one(f"regexp_matches(norm, '(?i){refdata.PATTERNS['bank_change']}')", "0.95")
_BEC = f"(1 + CAST({_kw('finance', 3)} > 0 AS INTEGER) + CAST(regexp_matches(concat_ws(chr(10), display, right(text_body, 400)), '(?i){refdata.PATTERNS['executive']}') AS INTEGER))"
_CHECK_SQL["content.bec_pattern"] = _one(f"{_kw('bec', 6)} > 0 AND {_BEC} >= 2", f"CASE WHEN {_BEC} = 3 THEN 1.0 ELSE 0.75 END")
_CHECK_SQL["header.displayname_email"] = _one(r"regexp_matches(display, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AND lower(regexp_extract(display, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) <> addr", "0.95")
_CHECK_SQL["header.replyto_mismatch"] = _one(f"from_domain <> '' AND reply_domain <> '' AND NOT {_REG('from_domain', 'reply_domain')}", "0.9")
_CHECK_SQL["header.messageid_missing"] = _one("from_domain IS NOT NULL", "0.6")
for _id, _c in (("spf_fail", "spf IN ('fail','permerror')|0.9"), ("spf_softfail", "spf = 'softfail'|0.8"), ("dkim_fail", "dkim IN ('fail','permerror')|0.85"), ("dmarc_fail", "dmarc IN ('fail','permerror')|0.95")):
    _CHECK_SQL[f"auth.{_id}"] = _one(*_c.split("|"))
_CHECK_SQL["domain.punycode"] = _one("contains(from_domain, 'xn--')", "0.9")
_CHECK_SQL["domain.mixed_script"] = _one(r"regexp_matches(from_domain, '\p{Latin}') AND regexp_matches(regexp_replace(from_domain, '\p{Latin}', '', 'g'), '\p{L}')", "0.95")
_CHECK_SQL["domain.free_mail_org"] = None  # set below with the others that need brands: rows only
_LINK = "SELECT msg_id, unnest(links) AS l FROM mail"
_CHECK_SQL["link.ip_host"] = f"WITH {W}, l AS ({_LINK}) SELECT msg_id, CAST(0.9 AS DOUBLE) AS confidence FROM l WHERE regexp_matches(l.host, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') GROUP BY msg_id"
_CHECK_SQL["link.shortener"] = f"WITH {W}, l AS (SELECT DISTINCT msg_id, lower(l.host) AS h FROM ({_LINK})) SELECT msg_id, CAST(0.8 AS DOUBLE) AS confidence FROM l WHERE list_contains({V.list_sql(refdata.SHORTENERS)}, h) OR list_contains({V.list_sql(refdata.SHORTENERS)}, {V.registrable_sql('h')})"
_CHECK_SQL["link.many_domains"] = f"WITH {W}, l AS (SELECT msg_id, count(DISTINCT {V.registrable_sql('lower(l.host)')}) AS n FROM ({_LINK}) WHERE l.host <> '' GROUP BY 1) SELECT msg_id, round(least(1.0, n / 10.0), 6) AS confidence FROM l WHERE n >= 5"
_CHECK_SQL["link.data_uri"] = f"WITH {W}, l AS ({_LINK}) SELECT msg_id, CAST(0.9 AS DOUBLE) AS confidence FROM l WHERE lower(trim(l.href)) LIKE 'data:%' GROUP BY msg_id"
_CHECK_SQL["link.nonstandard_port"] = f"WITH {W}, l AS (SELECT msg_id, regexp_extract(l.href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]*:([0-9]+)', 1) AS port FROM ({_LINK})) SELECT msg_id, CAST(0.7 AS DOUBLE) AS confidence FROM l WHERE port NOT IN ('', '80', '443') GROUP BY msg_id"
_CHECK_SQL["link.obfuscated"] = f"WITH {W}, l AS ({_LINK}), o AS (SELECT msg_id, count(*) AS n FROM l WHERE regexp_matches(trim(l.href), '^(?i:data|javascript):') OR regexp_matches(l.href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') OR regexp_matches(l.href, '[A-Za-z0-9+/_-]{{40,}}') OR regexp_matches(l.href, '(?i)(?:%[0-9a-f]{{2}}){{8,}}|[0-9a-f]{{32,}}') GROUP BY 1) SELECT msg_id, CAST(0.8 AS DOUBLE) AS confidence FROM o, unnest(range(least(n, 3)))"
_CHECK_SQL["link.missing_unsubscribe"] = _one(f"len(links) > 0 AND len(list_filter({V.list_sql(refdata.MARKETING_WORDS)}, lambda w: contains(lower(concat_ws(chr(10), subject, text_body)), w))) > 0 AND len(list_filter({V.list_sql(refdata.UNSUBSCRIBE_WORDS)}, lambda w: contains(lower(concat_ws(chr(10), subject, text_body)), w))) = 0", "0.75")
_SHOWN = "lower(regexp_extract(l.anchor, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1))"
_CHECK_SQL["link.text_href_mismatch"] = f"WITH {W}, l AS (SELECT msg_id, lower(l.host) AS h, {_SHOWN} AS shown FROM ({_LINK}) WHERE NOT regexp_matches(trim(l.anchor), '\\s')), o AS (SELECT msg_id, count(*) AS n FROM l WHERE h <> '' AND shown <> '' AND NOT {_REG('h', 'shown')} GROUP BY 1) SELECT msg_id, CAST(0.95 AS DOUBLE) AS confidence FROM o, unnest(range(least(n, 3)))"
_FILE = "SELECT msg_id, unnest(files) AS f FROM mail"
_EXT = r"lower(regexp_extract(trim(f), '\.([^./]*)$', 1))"
_CHECK_SQL["attachment.dangerous_ext"] = f"WITH {W}, a AS ({_FILE}) SELECT msg_id, CAST(0.95 AS DOUBLE) AS confidence FROM a WHERE list_contains({V.list_sql(refdata.DANGEROUS_EXT)}, {_EXT})"
_CHECK_SQL["attachment.double_ext"] = f"WITH {W}, a AS (SELECT msg_id, string_split(lower(f), '.') AS p FROM ({_FILE})) SELECT msg_id, CAST(0.95 AS DOUBLE) AS confidence FROM a WHERE len(p) >= 3 AND list_contains({V.list_sql(refdata.DANGEROUS_EXT)}, p[-1]) AND list_contains({V.list_sql(refdata.DOCUMENT_EXT)}, p[-2])"
_HOP_IPS = "hop AS (SELECT DISTINCT hop_id, submission_id, ip FROM received_hops)"
_CHECK_SQL["header.received_private_ip"] = rf"WITH {W}, {_HOP_IPS} SELECT msg_id, CAST(0.5 AS DOUBLE) AS confidence FROM mail WHERE submission_id IN (SELECT submission_id FROM hop WHERE regexp_matches(ip, '^(10|127|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^2(2[4-9]|3[0-9])\.'))"
_CHECK_SQL["auth.unverified"] = f"WITH {W}, {_HOP_IPS} SELECT msg_id, CAST(0.5 AS DOUBLE) AS confidence FROM mail WHERE coalesce(spf, dkim, dmarc) IS NULL AND submission_id IN (SELECT submission_id FROM hop)"
_RISK = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in refdata.RISKY_TLDS.items()) + "}"
_CHECK_SQL["domain.risky_tld"] = f"WITH {W}, h AS (SELECT msg_id, from_domain AS h FROM mail UNION ALL SELECT msg_id, lower(l.host) FROM ({_LINK})), t AS (SELECT DISTINCT msg_id, string_split(h, '.')[-1] AS t FROM h WHERE contains(h, '.')) SELECT msg_id, round(least(1.0, {_RISK}[t] / 10.0), 6) AS confidence FROM t WHERE {_RISK}[t] IS NOT NULL"
_IDS = r"list_filter(regexp_extract_all(norm, '(?:^|[^0-9A-Za-z_])([0-9]{12})\b', 1), lambda n: n <> '000000000000' AND (CASE WHEN list_sum(list_transform(range(1, 12), lambda i: CAST(n[i] AS INTEGER) * i)) % 11 = 10 THEN list_sum(list_transform(range(1, 12), lambda i: CAST(n[i] AS INTEGER) * CASE WHEN i <= 9 THEN i + 2 ELSE i - 9 END)) % 11 ELSE list_sum(list_transform(range(1, 12), lambda i: CAST(n[i] AS INTEGER) * i)) % 11 END) = CAST(n[12] AS INTEGER))"
_CHECK_SQL["content.kz_identifier"] = _one(f"len({_IDS}) > 0", "0.7")
_CHANGE = f"regexp_matches(norm, '(?i){refdata.PATTERNS['bank_change']}')"
_CHECK_SQL["content.finance_request"] = _one(f"{_CHANGE} OR {_kw('finance', 4)} >= 2", f"CASE WHEN {_CHANGE} THEN 1.0 ELSE least(1.0, {_DENS(_kw('finance', 4))} * 0.8 + CASE WHEN len({_IDS}) > 0 THEN 0.15 ELSE 0.0 END) END")

_RD = V.registrable_sql("from_domain")
_CHECK_SQL["header.returnpath_mismatch"] = f"WITH {W}, b AS (SELECT submission_id, nullif(lower(trim(arg_min(addr_domain, addr_id))), '') AS back FROM addresses WHERE addr_role = 'return_path' AND submission_id IS NOT NULL GROUP BY 1) SELECT msg_id, CAST(0.7 AS DOUBLE) AS confidence FROM mail JOIN b USING (submission_id) WHERE from_domain <> '' AND back <> '' AND NOT {_REG('from_domain', 'back')}"
_TIMES = f"t AS (SELECT submission_id, last(TRY_CAST(hop_ts AS TIMESTAMPTZ) ORDER BY hop_no, hop_id) AS first_hop FROM (SELECT DISTINCT ON (hop_id) * FROM received_hops) WHERE submission_id IS NOT NULL AND regexp_matches(hop_ts, '{V.ISO}') AND TRY_CAST(hop_ts AS TIMESTAMPTZ) IS NOT NULL GROUP BY 1)"
_CHECK_SQL["header.date_skew"] = f"WITH {W}, {_TIMES}, d AS (SELECT msg_id, first_hop, TRY_CAST(mail_date AS TIMESTAMPTZ) AS sent FROM mail LEFT JOIN t USING (submission_id)) SELECT msg_id, CAST(0.7 AS DOUBLE) AS confidence FROM d WHERE coalesce(abs(floor(epoch(sent)) - floor(epoch(first_hop))) > 86400, epoch(sent) >= epoch(TIMESTAMPTZ '{V.AS_OF}+00') + 86400)"
_LISTED_IPS = f"WITH {W}, b AS (SELECT DISTINCT submission_id FROM received_hops WHERE hop_id IS NOT NULL AND regexp_matches(ip, '^[0-9.]*[02468]$')) SELECT msg_id, CAST(0.9 AS DOUBLE) AS confidence FROM mail WHERE submission_id IN (SELECT submission_id FROM b WHERE submission_id IS NOT NULL)"
_CHECK_SQL |= {"header.received_ip_listed": _LISTED_IPS, "reputation.ip_listed": _LISTED_IPS}
_CHECK_SQL["reputation.domain_age"] = _one(f"regexp_matches(md5({_RD}), '^[0-3]')", "0.9")
_FEED = r"feed AS (SELECT lower(trim(ioc_value)) AS host FROM iocs WHERE ioc_kind = 'domain' AND ioc_value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT org_id) >= 2)"
_LH = "list_transform(links, lambda l: lower(l.host))"
_VALUES = f"v AS (SELECT msg_id, unnest(list_distinct(list_filter(list_concat([addr, from_domain, {_RD}, reply_addr, reply_domain, {V.registrable_sql('reply_domain')}], {_LH}, list_transform({_LH}, lambda h: {V.registrable_sql('h')})), lambda x: x IS NOT NULL AND x <> ''))) AS value FROM mail)"
_BLOCKED = f"{_FEED}, {_VALUES}, blocked AS (SELECT DISTINCT msg_id FROM v JOIN feed ON value = regexp_replace(host, '\\.+$', ''))"
_CHECK_SQL["reputation.org_blocklist"] = f"WITH {W}, {_BLOCKED} SELECT msg_id, CAST(1.0 AS DOUBLE) AS confidence FROM blocked"
_CHECK_SQL["reputation.org_allowlist"] = f"WITH {W}, {_BLOCKED} SELECT msg_id, CAST(1.0 AS DOUBLE) AS confidence FROM mail WHERE msg_id NOT IN (SELECT msg_id FROM blocked) AND (from_domain IN (SELECT lower(domain_name) FROM known_domains WHERE domain_name IS NOT NULL) OR {_RD} IN (SELECT lower(domain_name) FROM known_domains WHERE domain_name IS NOT NULL))"
_CHECK_SQL["reputation.domain_listed"] = f"WITH {W}, {_FEED}, h AS (SELECT msg_id, unnest(list_distinct(list_filter(list_concat([from_domain], {_LH}), lambda x: x IS NOT NULL AND x <> ''))) AS host FROM mail) SELECT msg_id, CAST(1.0 AS DOUBLE) AS confidence FROM h JOIN feed USING (host)"
_CHECK_SQL["attachment.virustotal"] = f"WITH {W}, e AS (SELECT DISTINCT submission_id, lower(trim(h)) AS sha FROM (SELECT submission_id, unnest(attachment_sha256) AS h FROM notify_events WHERE submission_id IS NOT NULL) WHERE h IS NOT NULL) SELECT msg_id, CAST(0.95 AS DOUBLE) AS confidence FROM mail JOIN e USING (submission_id) WHERE regexp_matches(sha, '^[01]')"
_CHECK_SQL["link.login_form"] = f"WITH {W}, l AS (SELECT msg_id, l.href AS href, row_number() OVER (PARTITION BY msg_id) AS n FROM ({_LINK}) WHERE starts_with(md5(l.href), '0')) SELECT msg_id, CAST(0.95 AS DOUBLE) AS confidence FROM l WHERE n <= 3"
for _v in ("phishing", "suspicious", "clean"):
    _CHECK_SQL[f"semantic.llm_{_v}"] = f"WITH {W}, o AS (SELECT submission_id, arg_min(verdict, event_no) AS v FROM notify_events WHERE submission_id IS NOT NULL AND verdict IN ('phishing', 'suspicious', 'clean') GROUP BY 1) SELECT msg_id, CAST(0.8 AS DOUBLE) AS confidence FROM mail JOIN o USING (submission_id) WHERE v = '{_v}'"
_MADE = lambda where, confidence: f"WITH {V.MADE_SQL} SELECT CAST(summary_id AS VARCHAR) AS msg_id, CAST({confidence} AS DOUBLE) AS confidence FROM made WHERE {where}"
_CHECK_SQL["link.tracking_pixel"] = _MADE("summary_id % 4 = 0", 0.8)
_CHECK_SQL["header.bulk_mailer_personal"] = _MADE("summary_id % 5 = 0", 0.75)
_CHECK_SQL["attachment.archive_executable"] = _MADE("summary_id % 9 = 0", 0.95)
_CHECK_SQL["attachment.archive_encrypted"] = _MADE("summary_id % 10 = 0", 0.9)
_CHECK_SQL["attachment.macro"] = _MADE("summary_id % 11 = 0", 0.95)
_CHECK_SQL["attachment.rtl_override"] = _MADE("summary_id % 13 = 0", 1.0)
_CHECK_SQL["link.cloud_form"] = _MADE("summary_id % 14 = 0", 0.85)
_CHECK_SQL["content.image_only"] = _MADE("summary_id % 15 = 0", 0.8)
_CHECK_SQL["content.hidden_text"] = _MADE("summary_id % 6 = 0", 0.8)
_CHECK_SQL["attachment.html_active"] = _MADE("summary_id % 7 = 0", 0.9)
_CHECK_SQL["attachment.pdf_active"] = _MADE("summary_id % 8 = 0", 0.9).replace("CAST(summary_id AS VARCHAR)", "'pdf' || summary_id")
_CHECK_SQL["header.messageid_mismatch"] = _MADE("summary_id % 3 = 0 AND contains(mail_from, '@')", 0.6)

_NEEDS_HOPS = {"header.received_private_ip", "header.received_ip_listed", "header.date_skew", "auth.unverified", "reputation.ip_listed"}
_NEEDS_BRANDS = {"auth.dkim_none", "auth.aligned_official", "domain.brand_lookalike", "domain.free_mail_org", "link.brand_lookalike", "content.generic_greeting", "content.language_mismatch", "brand.sender_mismatch"}


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "iocs").where("ioc_kind = 'domain' AND ioc_value IS NOT NULL").select(F.lower(F.trim("ioc_value")).alias("host"), "org_id")
    return i.groupBy("host").agg(F.count_distinct("org_id").alias("n")).where("n >= 2").select("host", F.lit("reports").alias("source"), F.lit(1).alias("priority"))


def _lookup(spark: SparkSession, sf: str, name: str, mail: DataFrame) -> DataFrame:
    """A lookup table made of the test tables, by rules that the SQL of the checks repeats.

    Feeds and block lists hold the domains that two organisations or more
    report, allow lists the known ones. Addresses with an even last number are
    answered as listed. Sender domains whose hash begins with 0 to 3 are
    fifteen days old. Hashes that begin with 0 or 1 are bad, links lead to a
    login form if their own hash begins with 0. Opinions repeat a submission's verdict.
    """
    if name == "feeds":
        return _feed(spark, sf)
    if name == "lists":
        block = _feed(spark, sf).select(F.lit("").alias("org_id"), F.lit("block").alias("kind"), F.col("host").alias("value"))
        return block.unionByName(table(spark, sf, "known_domains").where("domain_name IS NOT NULL").select(F.lit("").alias("org_id"), F.lit("allow").alias("kind"), F.col("domain_name").alias("value")))
    if name == "dns":
        ips = table(spark, sf, "received_hops").where(F.col("ip").rlike(r"^[0-9.]*[02468]$")).select("ip").distinct()
        return ips.select("ip", F.lit("127.0.0.2").alias("answer"), F.lit(0).alias("abuse_score"))
    if name == "registrations":
        young = mail.select(H.registrable_domain(F.col("from.domain")).alias("domain")).where(F.md5("domain").rlike("^[0-3]")).distinct()
        return young.select("domain", (F.to_timestamp(F.lit(V.AS_OF)) - F.expr("INTERVAL 15 DAYS")).alias("registered_at"))
    if name == "hashes":
        return mail.select(F.explode(F.transform("attachments", lambda x: x["sha256"])).alias("sha256")).where(F.col("sha256").rlike("^[01]")).distinct().withColumns({"malicious": F.lit(1), "suspicious": F.lit(0)})
    if name == "logins":
        links = mail.select(F.explode(F.transform("links", lambda x: x["href"])).alias("url")).where(F.md5("url").startswith("0")).distinct()
        return links.select("url", F.lit(True).alias("has_login_form"))
    if name == "opinions":
        told = table(spark, sf, "notify_events").where("submission_id IS NOT NULL AND verdict IN ('phishing', 'suspicious', 'clean')").groupBy("submission_id").agg(F.min_by(F.struct("verdict", "attack_type"), "event_no").alias("o"))
        llm = F.struct(F.col("o.verdict").alias("verdict_opinion"), F.col("o.attack_type").alias("attack_type"), F.lit(None).cast("string").alias("recommended_action"), F.lit(1).alias("highlights"))
        return mail.select("msg_id", "submission_id").join(told, "submission_id").select("msg_id", llm.alias("llm"))
    return V.brands(spark, sf) if name == "brands" else mail  # of "senders" the mails are all there is


#: The lookups that checks need, and the ones that need a raw message.
_NEEDS = {"reputation.org_blocklist": ("lists",), "reputation.org_allowlist": ("lists",), "reputation.domain_listed": ("feeds",), "reputation.ip_listed": ("dns",), "header.received_ip_listed": ("dns",), "reputation.domain_age": ("registrations",), "attachment.virustotal": ("hashes",), "link.login_form": ("logins",), "semantic.llm_phishing": ("opinions",), "semantic.llm_suspicious": ("opinions",), "semantic.llm_clean": ("opinions",)}
_NEEDS |= {i: ("brands",) for i in _NEEDS_BRANDS} | {"domain.mixed_script": ("senders",)}
_RAW = {"attachment.archive_executable", "attachment.archive_encrypted", "attachment.macro", "attachment.rtl_override", "link.cloud_form", "content.image_only", "header.bulk_mailer_personal", "header.messageid_mismatch", "link.tracking_pixel", "content.hidden_text", "attachment.html_active", "attachment.pdf_active"}


def detected(spark: SparkSession, sf: str, *ids: str) -> DataFrame:
    """Mails with the signals of the checks named, or of all.

    The records are written once, and the lookups read the few columns they
    need of what was written. Checks on what only a raw message has run on
    messages made of the tables.
    """
    if ids and _RAW & set(ids):
        from mailquern.sources.mail import parse_mail

        return C.detect(parse_mail(V.made_messages(spark, sf)), ids)
    needs = sorted({n for i in ids or _NEEDS for n in _NEEDS.get(i, ())})
    mail = V.mails(spark, sf, hops=not ids or bool(_NEEDS_HOPS & set(ids)), paths=not ids or "header.returnpath_mismatch" in ids)
    if "hashes" in needs:
        mail = V.hashed(mail, spark, sf)
    if needs:
        mail = checkpointed(mail)
        mail = L.with_lookups(mail, **{n: _lookup(spark, sf, n, mail) for n in needs})
    return C.detect(mail.withColumn("as_of", F.to_timestamp(F.lit(V.AS_OF))), ids or None)


def _register_check(id: str) -> None:
    @R.query("check_" + id.replace(".", "_"), _CHECK_SQL.get(id))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return detected(spark, sf, id).select("msg_id", F.explode("signals").alias("s")).select("msg_id", F.round("s.confidence", 6).alias("confidence"))


for _id in C.emission_order():
    _register_check(_id)


@R.query("parse_messages", f"""WITH {V.MADE_SQL} SELECT CAST(summary_id AS VARCHAR) AS msg_id, lower(mail_from) AS addr, coalesce(trim(subject), '') AS subject, coalesce(spf, 'none') AS spf, coalesce(dkim, 'none') AS dkim, coalesce(dmarc, 'none') AS dmarc,
CAST(len(list_distinct(list_concat(list_transform(coalesce(links, []), lambda l: l.href), list_filter(list_transform(coalesce(links, []), lambda l: l.anchor), lambda a: starts_with(a, 'http'))))) + CAST(summary_id % 14 = 0 AS INTEGER) AS INTEGER) AS n_links, CAST(list_sum(list_transform([7, 9, 10, 11, 13, 15], lambda n: CAST(summary_id % n = 0 AS INTEGER))) AS INTEGER) AS n_files, false AS failed FROM made""")
def parse_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Raw messages made of the summaries, parsed back to the fields they were made of."""
    from mailquern.sources.mail import parse_mail

    m = parse_mail(V.made_messages(spark, sf).where("kind = 'eml'"))
    return m.select("msg_id", F.col("from.addr").alias("addr"), F.coalesce("subject", F.lit("")).alias("subject"), "spf", "dkim", "dmarc", F.size("links").alias("n_links"), F.size("attachments").alias("n_files"), F.col("error").isNotNull().alias("failed"))


@R.query("analyze")
def analyze(spark: SparkSession, sf: str) -> DataFrame:
    """Every mail through all checks to its score, verdict, confidence, attack type and signals."""
    d = S.score_messages(detected(spark, sf))
    return d.select("msg_id", "score", "verdict", "confidence", "attack_type", F.transform("signals", lambda s: s["id"]).alias("signal_ids"), "recommendations")


# -- scoring of the stored signals ------------------------------------------------------------------------------------

_WEIGHTS = "w(id, weight) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in refdata.WEIGHTS.items()) + ")"
_SIG = f"""WITH {_WEIGHTS}, e AS (SELECT * FROM notify_events QUALIFY row_number() OVER (PARTITION BY event_no) = 1),
x AS (SELECT DISTINCT event_no, coalesce(confidence, 1.0) AS confidence, unnest(signals) AS id FROM e),
s AS (SELECT event_no, x.id, coalesce(weight, 0) AS weight, confidence, CASE WHEN x.id LIKE 'reputation.%' THEN 1 WHEN x.id LIKE 'semantic.%' THEN 2 ELSE 0 END AS stage FROM x LEFT JOIN w USING (id) WHERE x.id IS NOT NULL),
raw AS (SELECT event_no, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list(struct_pack(k := CAST(weight AS DOUBLE) * confidence, st := stage, id := id) ORDER BY stage, id), lambda z: z.k)), lambda a, z: a + z) AS total,
  bool_or(id = 'reputation.org_blocklist') AS blocked, bool_or(id = 'reputation.org_allowlist') AS allowed, bool_or(id IN ('reputation.domain_listed', 'header.received_ip_listed') AND weight > 0) AS ti,
  count(*) FILTER (weight > 0 AND id NOT LIKE 'semantic.%') AS positives, bool_or(id LIKE 'attachment.%' AND weight > 0) AS att, bool_or(id LIKE 'content.bec_pattern%') AS bec, bool_or(id LIKE 'content.finance_request%') AS fin,
  bool_or(id LIKE 'link.%' AND weight > 0) AS link, bool_or(id LIKE 'content.credential_request%') AS cred, bool_or(id LIKE 'brand.%' AND weight > 0) AS imit FROM s GROUP BY 1),
n AS (SELECT e.event_no, greatest(0, least(100, sign(coalesce(total, 0)) * floor(abs(coalesce(total, 0)) + 0.5))) AS raw_score, coalesce(blocked, false) AS blocked, coalesce(allowed, false) AS allowed, coalesce(ti, false) AS ti, coalesce(positives, 0) AS positives,
  coalesce(att, false) AS att, coalesce(bec, false) AS bec, coalesce(fin, false) AS fin, coalesce(link, false) AS link, coalesce(cred, false) AS cred, coalesce(imit, false) AS imit FROM e LEFT JOIN raw USING (event_no)),
r AS (SELECT *, CAST(CASE WHEN blocked THEN greatest(raw_score, 70) WHEN ti AND raw_score < 40 THEN 40 ELSE raw_score END AS INTEGER) AS score FROM n),
v AS (SELECT *, CASE WHEN NOT blocked AND allowed AND score >= 70 THEN 'needs_review' WHEN blocked OR score >= 70 THEN 'phishing' WHEN score >= 40 THEN 'suspicious' ELSE 'clean' END AS verdict FROM r)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_messages(V.analyses(spark, sf))


@R.query("score_verdict", _SIG + "SELECT CAST(event_no AS VARCHAR) AS msg_id, score, verdict FROM v")
def score_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("msg_id", "score", "verdict")


@R.query("score_confidence", _SIG + "SELECT CAST(event_no AS VARCHAR) AS msg_id, floor(greatest(0.1::DOUBLE, least(0.99::DOUBLE, 0.5::DOUBLE + least(0.3::DOUBLE, CAST(least(abs(score - 70), abs(score - 40)) AS DOUBLE) / 100.0::DOUBLE) + least(0.15::DOUBLE, CAST(positives AS DOUBLE) * 0.03::DOUBLE))) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS confidence FROM v")
def score_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("msg_id", "confidence")


@R.query("score_attack_type", _SIG + "SELECT CAST(event_no AS VARCHAR) AS msg_id, CASE WHEN verdict = 'clean' THEN 'none' WHEN att THEN 'malware' WHEN bec THEN 'bec' WHEN fin AND NOT link THEN 'invoice_fraud' WHEN cred OR link OR imit THEN 'credential_harvesting' ELSE 'spam' END AS attack_type FROM v")
def score_attack_type(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("msg_id", "attack_type")


@R.query("score_recommendations", _SIG + f"""SELECT CAST(event_no AS VARCHAR) AS msg_id, CASE WHEN verdict = 'clean' THEN 1 ELSE 2 + CAST(link OR imit AS INTEGER) + CAST(cred AS INTEGER) + CAST(att AS INTEGER) + CAST(bec OR fin OR event_no IN (SELECT event_no FROM s WHERE id = 'domain.free_mail_org') AS INTEGER) END AS n_advice FROM v""")
def score_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("msg_id", F.size("recommendations").alias("n_advice"))


@R.query("signals_ranked", _SIG + "SELECT CAST(event_no AS VARCHAR) AS msg_id, row_number() OVER (PARTITION BY event_no ORDER BY round(abs(weight * confidence), 9) DESC, stage, id) AS rank, id AS signal_id FROM s")
def signals_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("msg_id", F.posexplode("signals").alias("p", "s")).select("msg_id", (F.col("p") + 1).alias("rank"), F.col("s.id").alias("signal_id"))


@R.query("score_org_weights", _SIG.replace("('content.urgency', 10)", "('content.urgency', 30)") + "SELECT CAST(event_no AS VARCHAR) AS msg_id, score FROM v")
def score_org_weights(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_messages(V.analyses(spark, sf), S.merged_weights({}, {"content.urgency": 30})).select("msg_id", "score")


# -- brands -----------------------------------------------------------------------------------------------------------


def _sender_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "addresses").where("addr_domain IS NOT NULL").select(F.lower("addr_domain").alias("host"))


@R.query("brand_match_hosts")
def brand_match_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return B.match_hosts(_sender_hosts(spark, sf), V.brands(spark, sf)).select("host", "name", "official", "method", F.round("score", 6).alias("score"))


@R.query("brand_official", """WITH h AS (SELECT DISTINCT lower(addr_domain) AS host FROM addresses WHERE addr_domain IS NOT NULL), k AS (SELECT DISTINCT lower(domain_name) AS d FROM known_domains)
SELECT DISTINCT host, string_split(d, '.')[1] AS name FROM h JOIN k ON host = d OR suffix(host, '.' || d)""")
def brand_official(spark: SparkSession, sf: str) -> DataFrame:
    return B.match_hosts(_sender_hosts(spark, sf), V.brands(spark, sf)).where("official").select("host", "name")


@R.query("brand_match_text", """WITH k AS (SELECT string_split(lower(domain_name), '.')[1] AS name, min(domain_id) AS o FROM known_domains GROUP BY 1), d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, arg_min(name, o) AS name, 0.5 AS score FROM d JOIN k ON contains(t, name) GROUP BY 1""")
def brand_match_text(spark: SparkSession, sf: str) -> DataFrame:
    return B.match_texts(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text", V.brands(spark, sf)).select("doc_id", "name", "score")


# -- joins ------------------------------------------------------------------------------------------------------------


@R.query("list_block_hits", rf"""WITH {W}, feed AS (SELECT lower(trim(ioc_value)) AS host FROM iocs WHERE ioc_kind = 'domain' AND ioc_value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT org_id) >= 2),
c AS (SELECT msg_id, unnest([addr, from_domain, {V.registrable_sql('from_domain')}, reply_domain, {V.registrable_sql('reply_domain')}]) AS v FROM mail UNION ALL SELECT msg_id, unnest([lower(l.host), {V.registrable_sql('lower(l.host)')}]) FROM ({_LINK}))
SELECT DISTINCT msg_id FROM c WHERE v <> '' AND v IN (SELECT regexp_replace(host, '\.+$', '') FROM feed)""")
def list_block_hits(spark: SparkSession, sf: str) -> DataFrame:
    mail = V.mails(spark, sf)
    return L.list_hits(mail, _lookup(spark, sf, "lists", mail)).where("block_hit IS NOT NULL").select("msg_id")


@R.query("ti_domain_join", rf"""WITH {W}, feed AS (SELECT lower(trim(ioc_value)) AS host FROM iocs WHERE ioc_kind = 'domain' AND ioc_value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT org_id) >= 2),
c AS (SELECT msg_id, from_domain AS v FROM mail UNION SELECT msg_id, lower(l.host) FROM ({_LINK})) SELECT msg_id, count(DISTINCT v) AS n_listed FROM c WHERE v IN (SELECT regexp_replace(host, '\.+$', '') FROM feed) GROUP BY 1""")
def ti_domain_join(spark: SparkSession, sf: str) -> DataFrame:
    return L.listed_domains(V.mails(spark, sf), _feed(spark, sf)).select("msg_id", F.size("listed_domains").alias("n_listed"))


@R.query("ti_ip_first_hop", """WITH h AS (SELECT DISTINCT hop_id, submission_id, hop_no, ip FROM received_hops WHERE ip IS NOT NULL AND submission_id IS NOT NULL), bad AS (SELECT ip FROM h GROUP BY 1 HAVING count(*) >= 2)
SELECT submission_id, arg_max(ip, struct_pack(a := hop_no, b := hop_id)) AS first_listed FROM h WHERE ip IN (SELECT ip FROM bad) GROUP BY 1""")
def ti_ip_first_hop(spark: SparkSession, sf: str) -> DataFrame:
    """The earliest hop whose address a list holds; here, the addresses seen at least twice."""
    h = table(spark, sf, "received_hops").where("ip IS NOT NULL AND submission_id IS NOT NULL").select("hop_id", "submission_id", "hop_no", "ip").distinct()
    bad = h.groupBy("ip").count().where("count >= 2").select("ip")
    return h.join(bad, "ip", "left_semi").groupBy("submission_id").agg(F.max_by("ip", F.struct("hop_no", "hop_id")).alias("first_listed"))


@R.query("submission_analysis_left", f"WITH {V.SUBMISSIONS_SQL}, {V.ANALYSES_SQL} SELECT sub.submission_id, ana.verdict, ana.score FROM sub LEFT JOIN ana USING (submission_id)")
def submission_analysis_left(spark: SparkSession, sf: str) -> DataFrame:
    return V.submissions(spark, sf).join(V.analysed(spark, sf).select("submission_id", "verdict", "score"), "submission_id", "left").select("submission_id", "verdict", "score")


@R.query("unsummarised_anti", f"WITH {V.SUBMISSIONS_SQL} SELECT submission_id FROM sub WHERE submission_id NOT IN (SELECT submission_id FROM message_summaries WHERE submission_id IS NOT NULL)")
def unsummarised_anti(spark: SparkSession, sf: str) -> DataFrame:
    return V.submissions(spark, sf).join(table(spark, sf, "message_summaries").select("submission_id"), "submission_id", "left_anti").select("submission_id")


# -- analytics --------------------------------------------------------------------------------------------------------

_FACT = f"WITH {V.SUBMISSIONS_SQL}, {V.ANALYSES_SQL}, fact AS (SELECT sub.*, ana.verdict, ana.attack_type, ana.brand, ana.signals, ana.sender_domain, ana.link_domains FROM sub JOIN ana USING (submission_id)) "


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return V.submissions(spark, sf).join(V.analysed(spark, sf).select("submission_id", "verdict", "attack_type", "brand", "signals", "sender_domain", "link_domains", "event_ts", "ingested_at"), "submission_id")


for _c in ("verdict", "review_status", "attack_type", "department", "channel"):

    def _count(spark: SparkSession, sf: str, column: str = _c) -> DataFrame:
        return A.count_by(_facts(spark, sf), column)

    R.query(f"stats_by_{_c}", _FACT + f"SELECT {_c}, count(*) AS n FROM fact WHERE {_c} <> '' GROUP BY 1")(_count)


@R.query("stats_all", _FACT + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM fact WHERE {c} <> '' GROUP BY 2" for c in ("verdict", "review_status", "attack_type", "department")))
def stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return A.stats_counts(_facts(spark, sf), "verdict", "review_status", "attack_type", "department")


@R.query("stats_latency", "WITH e AS (SELECT * FROM notify_events QUALIFY row_number() OVER (PARTITION BY event_no ORDER BY ingested_at) = 1), d AS (SELECT date_diff('millisecond', event_ts, ingested_at) AS ms FROM e) SELECT count(*) FILTER (ms >= 0) AS n, CAST(floor(avg(ms) FILTER (ms >= 0)) AS BIGINT) AS latency_ms FROM d")
def stats_latency(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "notify_events").groupBy("event_no").agg(F.min("ingested_at").alias("ingested_at"), F.min("event_ts").alias("event_ts"))
    return A.review_latency_ms(e, "event_ts", "ingested_at")


@R.query("stats_top_signals", _FACT + "SELECT signal, count(*) AS n FROM (SELECT unnest(signals) AS signal FROM fact) WHERE signal IS NOT NULL GROUP BY 1 ORDER BY n DESC, signal LIMIT 10")
def stats_top_signals(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_values(_facts(spark, sf), F.col("signals"), "signal")


@R.query("stats_top_brands", _FACT + "SELECT brand, count(*) AS n FROM fact WHERE brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, brand LIMIT 10")
def stats_top_brands(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_values(_facts(spark, sf), F.array("brand"), "brand")


_TACTIC = "CASE WHEN contains(signal, 'credential') OR contains(signal, 'sms_code') OR contains(signal, 'card_data') OR contains(signal, 'login_form') THEN 'credential_harvesting' WHEN contains(signal, 'bec') OR contains(signal, 'displayname') OR contains(signal, 'replyto') THEN 'authority_impersonation' WHEN contains(signal, 'urgency') OR contains(signal, 'threat') THEN 'urgency_and_fear' WHEN contains(signal, 'attachment') OR contains(signal, 'macro') OR contains(signal, 'archive') THEN 'malicious_attachment' WHEN contains(signal, 'finance') OR contains(signal, 'bank_detail') THEN 'invoice_fraud' ELSE 'other' END"


@R.query("tactic_counts", _FACT + f"SELECT {_TACTIC} AS tactic, CAST(sum(n) AS BIGINT) AS n FROM (SELECT signal, count(*) AS n FROM (SELECT unnest(signals) AS signal FROM fact) WHERE signal IS NOT NULL GROUP BY 1 ORDER BY n DESC, signal LIMIT 10) GROUP BY 1")
def tactic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.tactic_counts(stats_top_signals(spark, sf), "signal")


@R.query("campaigns_by_key", _FACT + "SELECT campaign, CAST(sum(n) AS BIGINT) AS members, min(m) AS first_member, string_agg(v || '=' || n, ',' ORDER BY v) AS verdicts FROM (SELECT campaign_key AS campaign, coalesce(verdict, '') AS v, count(*) AS n, min(submission_id) AS m FROM fact WHERE campaign_key IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def campaigns_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return A.campaigns(_facts(spark, sf), "campaign_key", "submission_id", "verdict")


_STORED = "nullif(concat_ws('|', nullif(sender_domain, ''), nullif(array_to_string(list_transform(list_filter(list_zip(link_domains, range(1, len(link_domains) + 1)), lambda z: z[1] <> '' AND list_position(link_domains, z[1]) = z[2]), lambda z: z[1]), '|'), '')), '')"


@R.query("campaigns_stored_key", _FACT + f"SELECT campaign, CAST(sum(n) AS BIGINT) AS members, min(m) AS first_member, string_agg(v || '=' || n, ',' ORDER BY v) AS verdicts FROM (SELECT {_STORED} AS campaign, coalesce(verdict, '') AS v, count(*) AS n, min(submission_id) AS m FROM fact GROUP BY 1, 2) WHERE campaign IS NOT NULL GROUP BY 1 HAVING sum(n) >= 2")
def campaigns_stored_key(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf).withColumn("k", A.stored_campaign_key(F.col("sender_domain"), F.coalesce("link_domains", F.array().cast("array<string>"))))
    return A.campaigns(f, "k", "submission_id", "verdict", min_members=2)


@R.query("campaigns_shown_key", rf"WITH {W} SELECT msg_id, coalesce(from_domain, '') || '|' || array_to_string(list_sort(list_distinct(list_filter(list_transform(links, lambda l: lower(l.host)), lambda h: h <> ''))), ',') || '|' || left(lower(trim(coalesce(subject, ''))), 40) AS campaign FROM mail")
def campaigns_shown_key(spark: SparkSession, sf: str) -> DataFrame:
    m = V.mails(spark, sf)
    return m.select("msg_id", A.shown_campaign_key(F.col("from.domain"), F.transform("links", lambda x: x["domain"]), F.col("subject")).alias("campaign"))


@R.query("iocs_extracted", rf"""WITH {W} SELECT DISTINCT msg_id, 'domain' AS ioc_kind, v AS ioc_value FROM (SELECT msg_id, unnest([from_domain, reply_domain]) AS v FROM mail UNION ALL SELECT msg_id, lower(l.host) FROM ({_LINK})) WHERE v <> ''
UNION ALL SELECT DISTINCT msg_id, 'url', l.href FROM ({_LINK}) WHERE l.href <> ''""")
def iocs_extracted(spark: SparkSession, sf: str) -> DataFrame:
    return A.indicators(V.mails(spark, sf))


@R.query("iocs_confirmed", f"WITH {V.SUBMISSIONS_SQL}, i AS (SELECT * FROM iocs QUALIFY row_number() OVER (PARTITION BY ioc_id) = 1) SELECT ioc_id, ioc_kind, ioc_value FROM i WHERE submission_id IN (SELECT submission_id FROM sub WHERE review_status = 'confirmed_phish')")
def iocs_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    return A.confirmed_indicators(table(spark, sf, "iocs").dropDuplicates(["ioc_id"]), V.submissions(spark, sf)).select("ioc_id", "ioc_kind", "ioc_value")


@R.query("awareness_cards", _FACT + "SELECT submission_id, verdict, attack_type, least(8, len(list_distinct(list_filter(coalesce(signals, []), lambda x: x IS NOT NULL)))) AS n_lessons FROM fact WHERE review_status = 'confirmed_phish'")
def awareness_cards(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf).withColumn("signals", F.coalesce("signals", F.array().cast("array<string>")))
    return A.awareness_cards(f).select("submission_id", "verdict", "attack_type", F.size("lessons").cast("long").alias("n_lessons"))


@R.query("submission_page", f"WITH {V.SUBMISSIONS_SQL} SELECT submission_id, created_at FROM sub WHERE org_id = 'org-001' AND department = 'finance' ORDER BY created_at DESC NULLS LAST, submission_id LIMIT 50 OFFSET 10")
def submission_page(spark: SparkSession, sf: str) -> DataFrame:
    return A.page(A.submissions_where(V.submissions(spark, sf), org_id="org-001", department="finance"), "created_at", "submission_id", 50, 10).select("submission_id", "created_at")


@R.query("subject_export", f"WITH {V.SUBMISSIONS_SQL}, who AS (SELECT min(submitted_by) AS w FROM sub) SELECT submission_id, org_id, channel FROM sub, who WHERE lower(submitted_by) = lower(w)")
def subject_export(spark: SparkSession, sf: str) -> DataFrame:
    s = V.submissions(spark, sf)
    who = s.agg(F.lower(F.min("submitted_by")).alias("w"))
    return s.join(F.broadcast(who), F.lower("submitted_by") == F.col("w")).select("submission_id", "org_id", "channel")


@R.query("retention_purge", f"WITH {V.SUBMISSIONS_SQL}, keep AS (SELECT submission_id FROM sub WHERE created_at >= TIMESTAMP '2025-01-01'), i AS (SELECT * FROM iocs QUALIFY row_number() OVER (PARTITION BY ioc_id) = 1) SELECT ioc_id FROM i WHERE submission_id IN (SELECT submission_id FROM keep)")
def retention_purge(spark: SparkSession, sf: str) -> DataFrame:
    kept = A.retained(V.submissions(spark, sf), "created_at", F.expr("TIMESTAMP_NTZ'2025-01-01 00:00:00'"))
    return A.kept_children(table(spark, sf, "iocs").dropDuplicates(["ioc_id"]), kept, "submission_id").select("ioc_id")


@R.query("latest_status", "SELECT submission_id, arg_max(verdict, struct_pack(a := ingested_at, b := verdict)) AS verdict, max(ingested_at) AS ingested_at FROM notify_events WHERE verdict IS NOT NULL GROUP BY 1")
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return A.latest_status(table(spark, sf, "notify_events").where("verdict IS NOT NULL"), "submission_id", "verdict", "ingested_at")


@R.query("upsert_status", f"WITH {V.SUBMISSIONS_SQL} SELECT submission_id, CASE WHEN review_status = 'in_review' THEN 'escalated' ELSE review_status END AS review_status FROM sub")
def upsert_status(spark: SparkSession, sf: str) -> DataFrame:
    s = V.submissions(spark, sf)
    return A.upserted(s, s.where("review_status = 'in_review'").withColumn("review_status", F.lit("escalated")), "submission_id").select("submission_id", "review_status")


# -- windows of time, as batch ----------------------------------------------------------------------------------------


@R.query("verdict_daily", "WITH e AS (SELECT * FROM notify_events QUALIFY row_number() OVER (PARTITION BY event_no) = 1) SELECT date_trunc('day', event_ts) AS day, verdict, count(*) AS n FROM e WHERE verdict IS NOT NULL GROUP BY 1, 2")
def verdict_daily(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "notify_events").dropDuplicates(["event_no"]).where("verdict IS NOT NULL")
    return e.groupBy(F.window("event_ts", "1 day").alias("w"), "verdict").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "verdict", "n")


@R.query("burst_sliding", "WITH e AS (SELECT * FROM notify_events QUALIFY row_number() OVER (PARTITION BY event_no) = 1), w AS (SELECT org_id, time_bucket(INTERVAL '6 hours', event_ts) - INTERVAL 6 HOUR * k AS start, event_ts FROM e, range(4) t(k) WHERE org_id IS NOT NULL) SELECT org_id, start, count(*) AS n FROM w WHERE event_ts < start + INTERVAL 1 DAY GROUP BY 1, 2 HAVING count(*) >= 5")
def burst_sliding(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "notify_events").dropDuplicates(["event_no"]).where("org_id IS NOT NULL")
    return e.groupBy(F.window("event_ts", "24 hours", "6 hours").alias("w"), "org_id").agg(F.count("*").alias("n")).where("n >= 5").select("org_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@R.query("campaign_sessions", f"""WITH {V.SUBMISSIONS_SQL}, g AS (SELECT campaign_key, created_at, CASE WHEN created_at < lag(created_at) OVER (PARTITION BY campaign_key ORDER BY created_at) + INTERVAL 3 DAY THEN 0 ELSE 1 END AS fresh FROM sub WHERE campaign_key IS NOT NULL),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY campaign_key ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT campaign_key, min(created_at) AS start, count(*) AS n FROM s GROUP BY campaign_key, k""")
def campaign_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = V.submissions(spark, sf).where("campaign_key IS NOT NULL")
    return s.groupBy(F.session_window("created_at", "3 days").alias("w"), "campaign_key").agg(F.count("*").alias("n")).select("campaign_key", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# -- evaluation and tuning --------------------------------------------------------------------------------------------

_JUDGED = f"WITH {V.SUBMISSIONS_SQL}, {V.ANALYSES_SQL}, j AS (SELECT ana.verdict, CASE review_status WHEN 'confirmed_phish' THEN 'phishing' ELSE 'clean' END AS want, ana.verdict = CASE review_status WHEN 'confirmed_phish' THEN 'phishing' ELSE 'clean' END AS ok FROM sub JOIN ana USING (submission_id) WHERE review_status IN ('confirmed_phish', 'confirmed_clean') AND ana.verdict IS NOT NULL), c AS (SELECT want AS class, CAST(ok AS INTEGER) AS tp, 0 AS fp, CAST(NOT ok AS INTEGER) AS fn, 1 AS support FROM j UNION ALL SELECT verdict, 0, 1, 0, 0 FROM j WHERE NOT ok), m AS (SELECT class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(support) AS BIGINT) AS support FROM c GROUP BY 1), f AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM m) "


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf).where(F.col("review_status").isin("confirmed_phish", "confirmed_clean") & F.col("verdict").isNotNull())
    got = f.select("submission_id", "verdict", F.lit(0).alias("score"), "signals")
    want = f.select("submission_id", F.when(F.col("review_status") == "confirmed_phish", "phishing").otherwise("clean").alias("want_verdict"), F.lit(None).cast("int").alias("min_score"), F.lit(None).cast("int").alias("max_score"), F.lit(None).cast("array<string>").alias("want_signals"))
    return E.judged(got, want, "submission_id")


@R.query("eval_confusion", _JUDGED + "SELECT class, tp, fp, fn, support, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM f")
def eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.class_metrics(_judged(spark, sf)).select("class", "tp", "fp", "fn", "support", F.round("f1", 9).alias("f1"))


@R.query("eval_macro_f1", _JUDGED + "SELECT round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 9) AS macro_f1, (SELECT round(avg(CAST(ok AS INTEGER)), 9) FROM j) AS accuracy FROM f WHERE support > 0")
def eval_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return E.macro(_judged(spark, sf)).select(F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"))


@R.query("pilot_metrics", _JUDGED + "SELECT count(*) FILTER (verdict = 'phishing' AND want = 'phishing') AS tp, count(*) FILTER (verdict = 'phishing' AND want <> 'phishing') AS fp, count(*) FILTER (verdict <> 'phishing' AND want = 'phishing') AS fn, count(*) FILTER (verdict <> 'phishing' AND want <> 'phishing') AS tn FROM j")
def pilot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.binary_metrics(_judged(spark, sf), "verdict", "want_verdict").select("tp", "fp", "fn", "tn")


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf).where(F.col("review_status").isin("confirmed_phish", "confirmed_clean"))
    ids = F.array_distinct(F.filter("signals", lambda s: s.isin(list(refdata.WEIGHTS))))
    return f.select(F.col("review_status").alias("label"), ids.alias("i")).where(F.size("i") > 0).select("label", F.map_from_arrays("i", F.transform("i", lambda _: F.lit(1.0))).alias("signals"))


@R.query("tune_weights")
def tune_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = E.tuned_weights(_examples(spark, sf), refdata.WEIGHTS)
    return spark.createDataFrame(sorted(w.items()), "signal string, weight int")


@R.query("tune_labels", f"{_FACT}SELECT review_status AS label, count(*) AS n FROM fact WHERE review_status IN ('confirmed_phish', 'confirmed_clean') AND len(list_filter(signals, lambda s: list_contains({V.list_sql(refdata.WEIGHTS)}, s))) > 0 GROUP BY 1")
def tune_labels(spark: SparkSession, sf: str) -> DataFrame:
    x = E.label_export(_examples(spark, sf), "label", "signals")
    return x.groupBy(F.get_json_object("value", "$.label").alias("label")).agg(F.count("*").alias("n"))


# -- texts for language models, exports -------------------------------------------------------------------------------


@R.query("redact_text")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    return O.redacted(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text"), "text").select("doc_id", "redacted")


@R.query("redact_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS emails FROM documents WHERE text IS NOT NULL")
def redact_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", O.redaction_counts(F.col("text"))["emails"].cast("long").alias("emails"))


@R.query("opinions_valid", "SELECT count(*) AS n, count(*) FILTER (verdict IN ('phishing', 'suspicious', 'clean') AND coalesce(attack_type, 'none') IN ('credential_harvesting', 'malware', 'invoice_fraud', 'bec', 'spam', 'none')) AS valid FROM (SELECT * FROM awareness_cards QUALIFY row_number() OVER (PARTITION BY card_id) = 1)")
def opinions_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Cards written as answers of a model, with words around the object, and read back."""
    c = table(spark, sf, "awareness_cards").dropDuplicates(["card_id"])
    answer = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.col("verdict").alias("verdict_opinion"), F.coalesce("attack_type", F.lit("none")).alias("attack_type"), F.lit("card").alias("summary"))), F.lit(" done"))
    return O.parsed_opinions(c.select(answer.alias("raw")), "raw").agg(F.count("*").alias("n"), F.count("opinion").alias("valid"))


@R.query("stix_patterns", r"""SELECT ioc_id, CASE ioc_kind WHEN 'domain' THEN '[domain-name:value = ''' || v || ''']' WHEN 'url' THEN '[url:value = ''' || v || ''']' WHEN 'sha256' THEN '[file:hashes.''SHA-256'' = ''' || v || ''']' END AS pattern
FROM (SELECT DISTINCT ioc_id, ioc_kind, replace(replace(ioc_value, '\', '\\'), '''', '\''') AS v FROM iocs WHERE ioc_value IS NOT NULL AND ioc_kind IS NOT NULL)""")
def stix_patterns(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "iocs").where("ioc_value IS NOT NULL AND ioc_kind IS NOT NULL").dropDuplicates(["ioc_id"])
    return i.select("ioc_id", X.stix_pattern(F.col("ioc_kind"), F.col("ioc_value")).alias("pattern"))


@R.query("stix_bundle")
def stix_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return X.stix_indicators(table(spark, sf, "iocs").where("ioc_value IS NOT NULL").dropDuplicates(["ioc_id"]))


@R.query("misp_attributes")
def misp_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return X.misp_attributes(table(spark, sf, "iocs").where("ioc_value IS NOT NULL").dropDuplicates(["ioc_id"]))


@R.query("verdict_threshold", "WITH e AS (SELECT * FROM notify_events QUALIFY row_number() OVER (PARTITION BY event_no) = 1) SELECT event_no FROM e WHERE verdict IN ('suspicious', 'needs_review', 'phishing')")
def verdict_threshold(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "notify_events").dropDuplicates(["event_no"])
    return e.where(X.verdict_rank(F.col("verdict")) >= 1).select("event_no")


@R.query("notify_payloads")
def notify_payloads(spark: SparkSession, sf: str) -> DataFrame:
    d = _scored(spark, sf).select("msg_id", "org_id", "verdict", "score", "attack_type", F.transform("signals", lambda s: s["id"]).alias("signals"))
    return X.payloads(d.where(X.verdict_rank(F.col("verdict")) >= 1), "case")


@R.query("metric_histogram", "WITH e AS (SELECT * FROM notify_events QUALIFY row_number() OVER (PARTITION BY event_no) = 1), b(le) AS (VALUES (0.05), (0.1), (0.25), (0.5), (1.0), (2.5), (5.0), (10.0)) SELECT channel, CAST(le AS DOUBLE) AS le, count(*) FILTER (confidence <= le) AS n FROM e, b GROUP BY 1, 2")
def metric_histogram(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "notify_events").dropDuplicates(["event_no"])
    return X.stage_histogram(e, "channel", "confidence").where("le < 1e9")
