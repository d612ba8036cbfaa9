"""The registered checks: each turns a mail into no, one or several signals.

A check is a column of ``array<struct<confidence,evidence>>`` over the fields
of a mail; ``detect`` joins them in the order in which signals are emitted. All
are expressions, so a mail passes every check in one stage. What other systems
know (lists, feeds, registration dates, opinions) comes in as columns that
``with_lookups`` joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from mailquern import refdata
from mailquern.functions import hosts as H, text as T

HIT = "array<struct<confidence:double,evidence:string>>"
Check = Callable[[], Column]
CHECKS: dict[str, tuple[str, Check]] = {}


def check(id: str, source: str = "heuristic") -> Callable[[Check], Check]:
    """Register a check; ids are unique."""

    def add(f: Check) -> Check:
        if id in CHECKS:
            raise ValueError(f"check {id} is registered twice")
        CHECKS[id] = (source, f)
        return f

    return add


c = F.col


def hit(confidence: Column | float, evidence: Column | str | None = None) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    conf = F.when(conf <= 0, 1.0).otherwise(F.least(conf, F.lit(1.0)))
    ev = evidence if isinstance(evidence, Column) else F.lit(evidence)
    return F.struct(conf.cast("double").alias("confidence"), F.left(F.coalesce(ev.cast("string"), F.lit("")), F.lit(300)).alias("evidence"))


def once(when: Column, confidence: Column | float, evidence: Column | str | None = None) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(hit(confidence, evidence))).otherwise(F.array().cast(HIT))


def each(items: Column, when: Callable[[Column], Column], confidence: float | Callable[[Column], Column], evidence: Callable[[Column], Column], most: int | None = None) -> Column:
    own = F.filter(items, lambda x: F.coalesce(when(x), F.lit(False)))
    out = F.transform(own, lambda x: hit(confidence(x) if callable(confidence) else confidence, evidence(x)))
    out = F.coalesce(out, F.array().cast(HIT))
    return F.slice(out, 1, most) if most else out


def first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items whose key no earlier item has."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def sender() -> Column:
    return c("from.domain")


def unofficial() -> Column:
    return c("brand.name").isNotNull() & ~c("brand.official")


def named(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def link_hosts() -> Column:
    return F.array_distinct(F.filter(F.transform("links", lambda x: x["domain"]), named))


def links_by_host() -> Column:
    return first_by(F.filter("links", lambda x: named(x["domain"])), lambda x: x["domain"])


def norm() -> Column:
    return c("norm_text")


def _differs(other: Column) -> Column:
    own = F.coalesce(F.exists("own_domains", lambda d: (other == d) | other.endswith(F.concat(F.lit("."), d))), F.lit(False))
    return named(sender()) & named(other) & ~H.same_registrable(sender(), other) & ~own


# -- header -----------------------------------------------------------------------------------------------------------


@check("header.displayname_email")
def displayname_email() -> Column:
    shown = F.lower(F.regexp_extract(c("from.display"), r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1))
    return once((shown != "") & (shown != F.lower("from.addr")), 0.95, c("from.display"))


@check("header.replyto_mismatch")
def replyto_mismatch() -> Column:
    return once(_differs(c("reply_to.domain")), 0.9, F.concat(sender(), F.lit(" -> "), c("reply_to.domain")))


@check("header.returnpath_mismatch")
def returnpath_mismatch() -> Column:
    return once(_differs(c("return_path.domain")), 0.7, F.concat(sender(), F.lit(" -> "), c("return_path.domain")))


@check("header.messageid_missing")
def messageid_missing() -> Column:
    return once(c("has_headers") & named(sender()) & (F.trim(F.coalesce("message_id", F.lit(""))) == ""), 0.6)


@check("header.messageid_mismatch")
def messageid_mismatch() -> Column:
    domain = F.regexp_replace(F.lower(F.substring_index("message_id", "@", -1)), r"[>\s]+$", "")
    return once(F.contains("message_id", F.lit("@")) & _differs(domain), 0.6, c("message_id"))


@check("header.date_skew")
def date_skew() -> Column:
    times = F.filter(F.transform("received", lambda x: x["ts"]), lambda t: t.isNotNull())
    first = F.try_element_at(times, F.lit(-1))
    far = F.abs(F.unix_timestamp("date") - F.unix_timestamp(first)) > 86400
    ahead = first.isNull() & (F.unix_timestamp("date") >= F.unix_timestamp("as_of") + 86400)
    return once(c("date").isNotNull() & F.coalesce(far, ahead), 0.7, c("date"))


@check("header.received_ip_listed", "ti")
def received_ip_listed() -> Column:
    ips = F.filter(F.transform("received", lambda x: x["ip"]), lambda ip: F.array_contains("listed_ips", ip))
    return once(F.size(ips) > 0, 0.9, F.get(ips, F.lit(0)))


@check("header.received_private_ip")
def received_private_ip() -> Column:
    ips = F.filter(F.transform("received", lambda x: x["ip"]), H.is_private_ip)
    return once(F.size(ips) > 0, 0.5, F.get(ips, F.lit(0)))


@check("header.bulk_mailer_personal")
def bulk_mailer_personal() -> Column:
    hits = F.filter(T.strings(refdata.BULK_MAILERS), lambda m: F.contains(F.lower("mailer"), m))
    return once((F.coalesce("to_count", F.lit(0)) <= 1) & (F.size(hits) > 0), 0.75, F.get(hits, F.lit(0)))


# -- authentication ---------------------------------------------------------------------------------------------------


@check("auth.spf_fail")
def spf_fail() -> Column:
    return once(c("spf").isin("fail", "permerror"), 0.9, c("spf"))


@check("auth.spf_softfail")
def spf_softfail() -> Column:
    return once(c("spf") == "softfail", 0.8, c("spf"))


@check("auth.dkim_fail")
def dkim_fail() -> Column:
    return once(c("dkim").isin("fail", "permerror"), 0.85, c("dkim"))


@check("auth.dkim_none")
def dkim_none() -> Column:
    return once((c("dkim") == "none") & c("brand.name").isNotNull(), 0.6, c("dkim"))


@check("auth.dmarc_fail")
def dmarc_fail() -> Column:
    return once(c("dmarc").isin("fail", "permerror"), 0.95, c("dmarc"))


@check("auth.unverified")
def unverified() -> Column:
    return once((F.size("received") > 0) & (F.coalesce("auth_source", F.lit("")) == ""), 0.5)


@check("auth.aligned_official")
def aligned_official() -> Column:
    return once(c("brand.official") & (c("spf") == "pass") & (c("dkim") == "pass") & (c("dmarc") == "pass") & ~sender().isin(refdata.FREE_MAIL), 1.0, sender())


# -- sender domain ----------------------------------------------------------------------------------------------------


@check("domain.punycode")
def domain_punycode() -> Column:
    return once(H.punycode(sender()), 0.9, sender())


@check("domain.mixed_script")
def domain_mixed_script() -> Column:
    return once(T.mixed_script(F.coalesce("from_unicode", sender())), 0.95, sender())


@check("domain.brand_lookalike")
def domain_brand_lookalike() -> Column:
    return once(c("sender_brand.name").isNotNull() & ~c("sender_brand.official"), c("sender_brand.score"), sender())


@check("domain.free_mail_org")
def free_mail_org() -> Column:
    in_display, in_text = T.matches(c("from.display"), refdata.PATTERNS["org_title"]), T.matches(T.last_lines(c("text_body")), refdata.PATTERNS["org_title"])
    conf = F.when(in_display, 1.0).when(unofficial(), 0.9).when(in_text, 0.8)
    return once(sender().isin(refdata.FREE_MAIL) & conf.isNotNull(), conf, sender())


@check("domain.risky_tld")
def risky_tld() -> Column:
    risk = T.lookup_map(refdata.RISKY_TLDS)
    hosts = H.distinct_hosts(F.array(sender()), link_hosts())
    return each(first_by(hosts, H.tld), lambda h: F.try_element_at(risk, H.tld(h)).isNotNull(), lambda h: F.least(F.lit(1.0), F.try_element_at(risk, H.tld(h)) / 10.0), lambda h: h)


# -- links ------------------------------------------------------------------------------------------------------------


@check("link.text_href_mismatch")
def text_href_mismatch() -> Column:
    return each(c("links"), lambda x: x["mismatch"], 0.95, lambda x: F.concat_ws(" -> ", x["text"], x["href"]), 3)


@check("link.ip_host")
def ip_host() -> Column:
    return each(c("links"), lambda x: x["is_ip"], 0.9, lambda x: x["href"], 1)


@check("link.nonstandard_port")
def nonstandard_port() -> Column:
    return each(c("links"), lambda x: ~F.coalesce(x["port"], F.lit("")).isin("", "80", "443"), 0.7, lambda x: x["href"], 1)


@check("link.shortener")
def shortener() -> Column:
    return each(links_by_host(), lambda x: x["is_shortener"], 0.8, lambda x: x["domain"])


@check("link.obfuscated")
def obfuscated() -> Column:
    def odd(x: Column) -> Column:
        href = F.trim(x["href"])
        return href.rlike(r"^(?i)(?:data|javascript):") | href.rlike(r"^(?i)[a-z][a-z0-9+.-]*://[^/?#]*@") | href.rlike(r"[A-Za-z0-9+/_\-]{40,}={0,2}") | href.rlike(r"(?i)(?:%[0-9a-f]{2}){8,}|[0-9a-f]{32,}")

    return each(c("links"), odd, 0.8, lambda x: x["href"], 3)


@check("link.data_uri")
def data_uri() -> Column:
    return each(c("links"), lambda x: F.lower(F.trim(x["href"])).startswith("data:"), 0.9, lambda x: x["href"], 1)


@check("link.punycode")
def link_punycode() -> Column:
    return each(links_by_host(), lambda x: x["punycode"] | T.mixed_script(x["domain"]), 0.9, lambda x: x["domain"])


@check("link.brand_lookalike")
def link_brand_lookalike() -> Column:
    return each(F.coalesce("link_brands", F.array().cast("array<struct<host:string,score:double>>")), lambda x: F.lit(True), lambda x: x["score"], lambda x: x["host"], 3)


@check("link.many_domains")
def many_domains() -> Column:
    n = F.size(F.array_distinct(F.transform(link_hosts(), lambda h: H.registrable_domain(h))))
    return once(n >= 5, F.least(F.lit(1.0), n / 10.0), n)


@check("link.cloud_form")
def cloud_form() -> Column:
    form = F.filter(link_hosts(), lambda h: h.isin(refdata.FORM_HOSTS))
    return once((F.size(form) > 0) & T.any_of(F.lower(F.concat_ws("\n", "subject", "text_body")), refdata.LOGIN_WORDS), 0.85, F.get(form, F.lit(0)))


@check("link.tracking_pixel")
def tracking_pixel() -> Column:
    small = F.size(F.filter("images", lambda x: (x["width"] <= 2) & (x["height"] <= 2) & (x["width"] > 0)))
    tags = F.least(F.regexp_count(F.coalesce("html_body", F.lit("")), F.lit(r"(?is)<img\b[^>]*(?:width\s*=\s*[\"']?1\b|height\s*=\s*[\"']?1\b)[^>]*>")), F.lit(3))
    n = small + tags
    return once(n > 0, F.least(F.lit(1.0), 0.6 + n * 0.2), n)


@check("link.missing_unsubscribe")
def missing_unsubscribe() -> Column:
    t = F.lower(F.concat_ws("\n", "subject", "text_body", "html_body"))
    return once((F.size("links") > 0) & T.any_of(t, refdata.MARKETING_WORDS) & ~T.any_of(t, refdata.UNSUBSCRIBE_WORDS), 0.75)


@check("link.login_form")
def login_form() -> Column:
    return each(F.coalesce("login_forms", F.array().cast("array<string>")), lambda x: F.lit(True), 0.95, lambda x: x, 3)


# -- attachments ------------------------------------------------------------------------------------------------------

_RTL = r"[\u202e\u202b]"


def _named(x: Column) -> Column:
    return ~x["name"].rlike(_RTL)


@check("attachment.rtl_override")
def rtl_override() -> Column:
    return each(c("attachments"), lambda x: x["name"].rlike(_RTL), 1.0, lambda x: x["name"])


@check("attachment.dangerous_ext")
def dangerous_ext() -> Column:
    return each(c("attachments"), lambda x: _named(x) & x["ext"].isin(refdata.DANGEROUS_EXT), 0.95, lambda x: x["name"])


@check("attachment.double_ext")
def double_ext() -> Column:
    def twice(x: Column) -> Column:
        parts = F.split(F.lower(x["name"]), r"\.")
        return _named(x) & (F.size(parts) >= 3) & F.element_at(parts, -1).isin(refdata.DANGEROUS_EXT) & F.try_element_at(parts, F.lit(-2)).isin(refdata.DOCUMENT_EXT)

    return each(c("attachments"), twice, 0.95, lambda x: x["name"])


@check("attachment.archive_encrypted")
def archive_encrypted() -> Column:
    return each(c("attachments"), lambda x: x["is_archive"] & x["password_protected"], 0.9, lambda x: x["name"])


@check("attachment.archive_executable")
def archive_executable() -> Column:
    bad = lambda n: F.lower(F.regexp_extract(n, r"\.([^./\\]*)$", 1)).isin(refdata.DANGEROUS_EXT) | n.rlike(_RTL)
    return each(c("attachments"), lambda x: x["is_archive"] & F.exists(x["nested_names"], bad), 0.95, lambda x: F.concat_ws("/", x["name"], F.get(F.filter(x["nested_names"], bad), F.lit(0))))


@check("attachment.macro")
def macro() -> Column:
    return each(c("attachments"), lambda x: x["macro_detected"], 0.95, lambda x: x["name"])


@check("attachment.pdf_active")
def pdf_active() -> Column:
    parts = F.array_compact(F.array(*(F.when(c(f"pdf.{f}"), F.lit(f)) for f in ("javascript", "open_action", "launch", "form", "embedded"))))
    return once(F.size(parts) > 0, 0.9, F.concat_ws(", ", parts))


@check("attachment.virustotal")
def virustotal() -> Column:
    return each(c("attachments"), lambda x: F.array_contains("listed_hashes", x["sha256"]), 0.95, lambda x: x["sha256"])


@check("attachment.html_active")
def html_active() -> Column:
    return each(c("attachments"), lambda x: x["has_active_content"], 0.9, lambda x: x["name"])


# -- content ----------------------------------------------------------------------------------------------------------

def _words(kind: str, most: int) -> Column:
    hits = T.match_all(norm(), refdata.KEYWORDS[kind], most)
    return once(F.size(hits) > 0, T.density(F.size(hits), norm()), F.array_join(hits, ", "))


@check("content.urgency")
def urgency() -> Column:
    return _words("urgency", 5)


@check("content.threat")
def threat() -> Column:
    return _words("threat", 5)


@check("content.credential_request")
def credential_request() -> Column:
    return _words("credential", 5)


@check("content.sms_code_request")
def sms_code_request() -> Column:
    return once(T.matches(norm(), refdata.PATTERNS["sms_code"]), 0.85)


@check("content.card_data_request")
def card_data_request() -> Column:
    return once(T.matches(norm(), refdata.PATTERNS["card_data"]), 0.8)


@check("content.generic_greeting")
def generic_greeting() -> Column:
    return once(unofficial() & T.matches(c("text_body"), refdata.PATTERNS["greeting"]), 0.7)


@check("content.language_mismatch")
def language_mismatch() -> Column:
    locale = F.substring_index("brand.locale", "-", 1)
    return once(named(c("language")) & named(c("brand.locale")) & (c("language") != locale), 0.8, F.concat_ws(" / ", "language", "brand.locale"))


@check("content.bec_pattern")
def bec_pattern() -> Column:
    bec, finance = T.match_all(norm(), refdata.KEYWORDS["bec"], 6), T.match_all(norm(), refdata.KEYWORDS["finance"], 3)
    title = T.matches(F.concat_ws("\n", "from.display", F.right("text_body", F.lit(400))), refdata.PATTERNS["executive"])
    n = F.lit(1) + (F.size(finance) > 0).cast("int") + title.cast("int")
    return once((F.size(bec) > 0) & (n >= 2), F.when(n == 3, 1.0).otherwise(0.75), F.array_join(F.concat(bec, finance), ", "))


@check("content.finance_request")
def finance_request() -> Column:
    hits = T.match_all(norm(), refdata.KEYWORDS["finance"], 4)
    change = T.matches(norm(), refdata.PATTERNS["bank_change"])
    extra = F.when(F.size(T.kz_identifiers(norm())) > 0, 0.15).otherwise(0.0)
    return once(change | (F.size(hits) >= 2), F.when(change, 1.0).otherwise(F.least(F.lit(1.0), T.density(F.size(hits), norm()) * 0.8 + extra)), F.array_join(hits, ", "))


@check("content.bank_detail_change")
def bank_detail_change() -> Column:
    return once(T.matches(norm(), refdata.PATTERNS["bank_change"]), 0.95, F.regexp_extract(norm(), f"(?iu){refdata.PATTERNS['bank_change']}", 0))


@check("content.kz_identifier")
def kz_identifier() -> Column:
    ids = T.kz_identifiers(norm())
    return once(F.size(ids) > 0, 0.7, F.get(ids, F.lit(0)))


@check("content.hidden_text")
def hidden_text() -> Column:
    which = F.coalesce(*(F.when(T.matches(c("html_body"), p), F.lit(name)) for name, p in refdata.HIDDEN_TEXT.items()))
    return once(which.isNotNull(), 0.8, which)


@check("content.image_only")
def image_only() -> Column:
    return once((F.size("images") > 0) & (F.trim(F.coalesce("ocr_text", F.lit(""))) == "") & (T.word_count(F.coalesce("text_body", F.lit(""))) <= 15), 0.8)


# -- brand, reputation, semantic --------------------------------------------------------------------------------------


@check("brand.sender_mismatch")
def sender_mismatch() -> Column:
    weak = sender().isin(refdata.FREE_MAIL) & (c("brand.method") == "keyword") & (c("brand.score") < 1)
    return once(unofficial() & named(sender()) & ~F.coalesce(weak, F.lit(False)), c("brand.score"), F.concat_ws(" / ", "brand.name", sender()))


@check("reputation.org_blocklist")
def org_blocklist() -> Column:
    return once(c("block_hit").isNotNull(), 1.0, c("block_hit"))


@check("reputation.org_allowlist")
def org_allowlist() -> Column:
    return once(c("block_hit").isNull() & c("allow_hit").isNotNull(), 1.0, c("allow_hit"))


@check("reputation.domain_listed", "ti")
def domain_listed() -> Column:
    return each(H.distinct_hosts(F.array(sender()), link_hosts()), lambda h: F.array_contains("listed_domains", h), 1.0, lambda h: h)


@check("reputation.ip_listed", "dns")
def ip_listed() -> Column:
    ips = F.filter(F.transform("received", lambda x: x["ip"]), lambda ip: F.array_contains("listed_ips", ip))
    return once(F.size(ips) > 0, 0.9, F.try_element_at(ips, F.lit(-1)))


@check("reputation.domain_age", "dns")
def domain_age() -> Column:
    return once(F.datediff(c("as_of").cast("date"), c("registered_at").cast("date")) < 30, 0.9, c("registered_at"))


def _opinion(verdict: str) -> Column:
    return once(c("llm.verdict_opinion") == verdict, F.when(c("llm.highlights") >= 2, 1.0).otherwise(0.8), c("llm.attack_type"))


@check("semantic.llm_phishing", "llm")
def llm_phishing() -> Column:
    return _opinion("phishing")


@check("semantic.llm_suspicious", "llm")
def llm_suspicious() -> Column:
    return _opinion("suspicious")


@check("semantic.llm_clean", "llm")
def llm_clean() -> Column:
    return _opinion("clean")


#: Columns that lookups fill; without one the checks that need it stay silent.
LOOKUPS = {
    "own_domains": "array<string>", "sender_brand": "struct<name:string,official:boolean,score:double>", "link_brands": "array<struct<host:string,score:double>>", "listed_ips": "array<string>",
    "listed_hashes": "array<string>", "listed_domains": "array<string>", "login_forms": "array<string>", "block_hit": "string", "allow_hit": "string", "registered_at": "timestamp", "from_unicode": "string", "as_of": "timestamp",
}


def _signal(id: str, source: str, weight: float) -> Callable[[Column], Column]:
    return lambda h: F.struct(F.lit(id).alias("id"), F.lit(id.split(".")[0]).alias("category"), F.lit(weight).alias("weight"), h["confidence"].alias("confidence"), h["evidence"].alias("evidence"), F.lit(source).alias("source"))


def emission_order() -> list[str]:
    """Check ids in the order their signals are emitted: by stage, then by id."""
    return sorted(CHECKS, key=lambda i: (refdata.STAGES.get(i.split(".")[0], 0), i))


def detect(mail: DataFrame, only: Iterable[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """``mail`` with ``signals``: an array of (id, category, weight, confidence, evidence, source) in emission order.

    ``only``: ids or categories to run. Checks are evaluated by category, one
    projection each, so that no generated method grows past what is compiled.
    """
    wanted = None if only is None else set(only)
    own = refdata.WEIGHTS | (weights or {})
    ids = [i for i in emission_order() if wanted is None or i in wanted or i.split(".")[0] in wanted]
    d = mail.withColumns({n: F.lit(None).cast(k) for n, k in LOOKUPS.items() if n not in mail.columns})
    d = d.withColumn("norm_text", T.norm_text(c("subject"), F.coalesce(F.nullif(c("text_body"), F.lit("")), c("ocr_text"))))
    parts: list[str] = []
    for category in dict.fromkeys(i.split(".")[0] for i in ids):
        mine = {}
        for i in (x for x in ids if x.split(".")[0] == category):
            source, f = CHECKS[i]
            name = "__" + i.replace(".", "_")
            mine[name] = F.transform(f(), _signal(i, source, float(own[i])))
        d = d.withColumns(mine)
        parts += mine
    return d.withColumn("signals", F.concat(*parts)).drop(*parts, "norm_text")
