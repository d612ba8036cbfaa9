"""The tables of a data folder as mail records and analyses; and the same in SQL, for the queries' checks.

A mail is a message summary with the body, display name and attachment names of
one prompt of the same submission, the received hops of it, its return path and
the hashes its events name. The first summary of a submission meets its first
prompt, the second its second, by their keys; what is left of either is a mail of
its own, so every summary and every prompt is in one mail and none is left out.
"""

from __future__ import annotations

import base64
import io
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mailquern import model, refdata
from mailquern.functions import hosts as H
from mailquern.functions.text import detect_language
from mailquern.operators.score import signals_from_ids
from mailquern.sources.files import extension  # noqa: F401 - the rule that the column below follows
from mailquern.tables import table


#: Times with a date, a clock with seconds and an offset, which every reader takes alike.
ISO = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:Z|[+-]\d\d:\d\d)$"
#: The day from which ages are counted.
AS_OF = "2026-12-31 00:00:00"


def mails(spark: SparkSession, sf: str, hops: bool = False, paths: bool = False) -> DataFrame:
    rank = lambda key: F.row_number().over(Window.partitionBy(F.coalesce("submission_id", F.col(key).cast("string"))).orderBy(key))  # noqa: E731 - rows of no submission stand alone
    s = table(spark, sf, "message_summaries").where("summary_id IS NOT NULL").dropDuplicates(["summary_id"]).withColumn("r", rank("summary_id"))
    p = table(spark, sf, "prompt_data").where("prompt_id IS NOT NULL").select("prompt_id", "submission_id", "mail_from", "reply_to", "subject", "body", "attachment_list").dropDuplicates(["prompt_id"]).withColumn("r", rank("prompt_id"))
    p = p.select(F.col("submission_id").alias("p_submission"), F.col("r").alias("p_r"), F.struct("prompt_id", "mail_from", "reply_to", "subject", "body", "attachment_list").alias("p"))
    d = s.join(p, (F.col("submission_id") == F.col("p_submission")) & (F.col("r") == F.col("p_r")), "full")
    d = d.withColumns({"submission_id": F.coalesce("submission_id", "p_submission"), "mail_from": F.coalesce("mail_from", "p.mail_from"), "reply_to": F.coalesce("reply_to", "p.reply_to"), "subject": F.coalesce("subject", "p.subject"), "msg_id": F.coalesce(F.col("summary_id").cast("string"), F.concat(F.lit("p"), F.col("p.prompt_id").cast("string")))})
    addr, reply = H.address_of(F.col("mail_from")), H.address_of(F.col("reply_to"))
    link = lambda x: F.struct(x["href"].alias("href"), x["anchor"].alias("text"), F.lower(x["host"]).alias("domain"), H.url_port(x["href"]).alias("port"), H.is_ipv4(x["host"]).alias("is_ip"), H.is_shortener(F.lower(x["host"])).alias("is_shortener"), H.punycode(F.lower(x["host"])).alias("punycode"), H.anchor_mismatch(x["anchor"], F.lower(x["host"])).alias("mismatch"))
    ext = lambda n: F.lower(F.regexp_extract(F.trim(n), r"\.([^./]*)$", 1))
    own = lambda name, mime, size: F.struct(name.alias("name"), mime.alias("mime"), size.alias("size"), F.lit(None).cast("string").alias("sha256"), ext(name).alias("ext"), F.lit(False).alias("macro_detected"), F.lit(False).alias("is_archive"), F.lit(False).alias("password_protected"), F.array().cast("array<string>").alias("nested_names"), F.lit(False).alias("has_active_content"))
    listed = F.when(F.coalesce("p.attachment_list", F.lit("")) != "", F.array(F.col("p.attachment_list"))).otherwise(F.array().cast("array<string>"))
    files = F.concat(F.transform(F.coalesce("attachments", F.array().cast("array<struct<file_name:string,mime:string,n_bytes:bigint>>")), lambda a: own(a["file_name"], a["mime"], a["n_bytes"])), F.transform(listed, lambda n: own(n, F.lit(None).cast("string"), F.lit(None).cast("long"))))
    d = d.select(
        "msg_id", "submission_id", F.struct(H.display_of(F.col("p.mail_from")).alias("display"), addr.alias("addr"), H.domain_of(addr).alias("domain")).alias("from"),
        F.struct(F.lit(None).cast("string").alias("display"), reply.alias("addr"), H.domain_of(reply).alias("domain")).alias("reply_to"), "subject", F.col("p.body").alias("text_body"), F.lit(True).alias("has_headers"),
        F.to_timestamp("mail_date").alias("date"), "spf", "dkim", "dmarc", F.when(F.coalesce("spf", "dkim", "dmarc").isNotNull(), "header").alias("auth_source"), F.transform("links", link).alias("links"), files.alias("attachments"),
        detect_language(F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("p.body", F.lit("")))).alias("language"),
    )
    if hops:
        h = table(spark, sf, "received_hops").where("submission_id IS NOT NULL").dropDuplicates(["hop_id"])
        h = h.groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("hop_no", "hop_id", "ip", F.when(F.col("hop_ts").rlike(ISO), F.try_to_timestamp("hop_ts")).alias("ts")))).alias("h"))
        d = d.join(h, "submission_id", "left").withColumn("received", F.transform("h", lambda x: F.struct(F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("from_host"), F.lit(None).cast("string").alias("by_host"), x["ip"].alias("ip"), x["ts"].alias("ts"))))
    if paths:
        back = table(spark, sf, "addresses").where("addr_role = 'return_path' AND submission_id IS NOT NULL").groupBy("submission_id").agg(F.min_by("addr_domain", "addr_id").alias("back"))
        d = d.join(back, "submission_id", "left").withColumn("return_path", F.struct(F.lit(None).cast("string").alias("display"), F.lit(None).cast("string").alias("addr"), F.lower(F.trim("back")).alias("domain")))
    return model.as_mail(d, "submission_id")


def hashed(mail: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """``mail`` with the hashes that the events of its submission name, each as a nameless attachment."""
    e = table(spark, sf, "notify_events").where("submission_id IS NOT NULL").select("submission_id", F.explode("attachment_sha256").alias("sha256")).where("sha256 IS NOT NULL")
    own = e.groupBy("submission_id").agg(F.array_sort(F.collect_set(F.lower(F.trim("sha256")))).alias("hashes"))
    bare = F.transform("hashes", lambda h: F.from_json(F.lit("{}"), model.ATTACHMENT).withField("sha256", h).withField("name", F.lit("")).withField("ext", F.lit("")))
    return mail.join(own, "submission_id", "left").withColumn("attachments", F.concat("attachments", F.coalesce(bare, F.array().cast(f"array<{model.ATTACHMENT}>")))).drop("hashes")


_ADDR = r"""coalesce(nullif(lower(regexp_extract(coalesce(s.mail_from, p.mail_from), '<([^<>\s]+@[^<>\s]+)>', 1)), ''), nullif(lower(regexp_extract(coalesce(s.mail_from, p.mail_from), '([^\s<>()"'',;]+@[^\s<>()"'',;]+)', 1)), ''))"""
_REPLY = _ADDR.replace("mail_from", "reply_to")
MAIL_SQL = rf"""
p AS (SELECT *, row_number() OVER (PARTITION BY coalesce(submission_id, CAST(prompt_id AS VARCHAR)) ORDER BY prompt_id) AS r FROM (SELECT * FROM prompt_data WHERE prompt_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prompt_id) = 1)),
s AS (SELECT *, row_number() OVER (PARTITION BY coalesce(submission_id, CAST(summary_id AS VARCHAR)) ORDER BY summary_id) AS r FROM (SELECT * FROM message_summaries WHERE summary_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY summary_id) = 1)),
mail AS (SELECT coalesce(CAST(s.summary_id AS VARCHAR), 'p' || p.prompt_id) AS msg_id, coalesce(s.submission_id, p.submission_id) AS submission_id,
  {_ADDR} AS addr,
  nullif(trim(regexp_replace(regexp_replace(p.mail_from, '<[^<>]*>\s*$', ''), '^\s*"|"\s*$', '', 'g')), '') AS display,
  nullif(regexp_extract({_ADDR}, '@([^@]*)$', 1), '') AS from_domain,
  {_REPLY} AS reply_addr, nullif(regexp_extract({_REPLY}, '@([^@]*)$', 1), '') AS reply_domain,
  coalesce(s.subject, p.subject) AS subject, p.body AS text_body, replace(lower(coalesce(s.subject, p.subject, '') || chr(10) || coalesce(p.body, '')), 'ё', 'е') AS norm,
  s.spf, s.dkim, s.dmarc, s.mail_date, coalesce(s.links, []) AS links,
  list_concat(list_transform(coalesce(s.attachments, []), lambda a: a.file_name), CASE WHEN coalesce(p.attachment_list, '') <> '' THEN [p.attachment_list] ELSE [] END) AS files
  FROM s FULL JOIN p ON s.submission_id = p.submission_id AND s.r = p.r)"""


def registrable_sql(h: str) -> str:
    """The rule of ``registrable_domain`` in SQL."""
    return f"CASE WHEN len(string_split({h}, '.')) < 3 THEN {h} WHEN string_split({h}, '.')[-2] IN ('com','net','org','gov','edu','ac','co','mil','bank') THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"


def words_sql(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> ''))"


def list_sql(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    """One row a notify event of kind analysis, with its signals as weighted records."""
    e = table(spark, sf, "notify_events").dropDuplicates(["event_no"])
    return e.select(F.col("event_no").cast("string").alias("msg_id"), "submission_id", "event_type", "org_id", "channel", "brand", "sender_domain", "link_domains", F.col("verdict").alias("told_verdict"), F.col("attack_type").alias("told_attack"), F.col("confidence").alias("told_confidence"), signals_from_ids(F.coalesce("signals", F.array().cast("array<string>")), F.coalesce("confidence", F.lit(1.0))).alias("signals"))


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "submissions").where("submission_id IS NOT NULL").dropDuplicates(["submission_id"])


SUBMISSIONS_SQL = "sub AS (SELECT * FROM submissions WHERE submission_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY submission_id) = 1)"
ANALYSES_SQL = "ana AS (SELECT * FROM notify_events WHERE event_type LIKE '%.analysis' QUALIFY row_number() OVER (PARTITION BY event_no) = 1)"


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "notify_events").where(F.col("event_type").endswith(".analysis")).dropDuplicates(["event_no"])


def brands(spark: SparkSession, sf: str) -> DataFrame:
    """The known domains as brands: domains of one first label are one brand's."""
    d = table(spark, sf, "known_domains").where("domain_name IS NOT NULL").select("domain_id", F.lower("domain_name").alias("d"))
    g = d.groupBy(F.substring_index("d", ".", 1).alias("name")).agg(F.array_sort(F.collect_set("d")).alias("domains"), F.min("domain_id").cast("int").alias("load_order"))
    return g.select("name", "domains", F.array().cast("array<string>").alias("esp_domains"), F.array("name").alias("keywords"), F.lit("global").alias("locale"), F.array().cast("array<string>").alias("colors"), F.lit(None).cast("bigint").alias("logo_phash"), F.lit("").alias("org_id"), "load_order")


def _zip(name: str, locked: bool = False) -> str:
    """A small archive with one file, in base64; ``locked`` sets its flag of encryption."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo(name), b"x")
    raw = bytearray(out.getvalue())
    if locked:
        raw[6] |= 1
        raw[raw.index(b"PK\x01\x02") + 8] |= 1
    return base64.b64encode(bytes(raw)).decode()


def _png(side: int = 8) -> str:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = zlib.compress((b"\0" + b"\x20\x80\xf0" * side) * side)
    return base64.b64encode(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")).decode()


def made_messages(spark: SparkSession, sf: str) -> DataFrame:
    """(path, kind, content): a raw message of each summary, with marks in body and headers by the summary's key.

    Every 4th has a one-pixel image, every 5th a bulk mailer, every 6th hidden
    text, every 7th an HTML attachment with a script, every 9th an archive with a
    program, every 10th a locked one, every 11th macros, every 13th a name that
    turns its direction, every 14th a form to log in, every 15th an image, and of
    every 3rd the message id is of another domain. Beside every 8th there is a PDF that opens an action.
    """
    s = table(spark, sf, "message_summaries").where("summary_id IS NOT NULL AND mail_from IS NOT NULL").dropDuplicates(["summary_id"])
    k, nth = F.col("summary_id"), lambda n: F.col("summary_id") % n == 0
    coded = lambda c: F.regexp_replace(F.base64(F.encode(c, "utf-8")), r"\s", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    part = lambda head, body: F.concat(F.lit("--b0\r\n" + head + "Content-Transfer-Encoding: base64\r\n\r\n"), coded(body), F.lit("\r\n"))
    file = lambda name, kind, content: F.lit(f'--b0\r\nContent-Type: {kind}\r\nContent-Disposition: attachment; filename="{name}"\r\nContent-Transfer-Encoding: base64\r\n\r\n{content}\r\n')
    link = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<struct<href:string,anchor:string,host:string>>")), lambda x: F.concat(F.lit('<a href="'), x["href"], F.lit('">'), F.coalesce(x["anchor"], F.lit("")), F.lit("</a>"))), " ")
    html = F.concat(F.lit("<html><body><p>Hello</p>"), link, F.when(nth(4), '<img src="https://t.example/p.gif" width="1" height="1">').otherwise(""), F.when(nth(6), '<span style="display:none">hidden words</span>').otherwise(""), F.when(nth(14), f'<a href="https://{refdata.FORM_HOSTS[0]}/f1">{refdata.LOGIN_WORDS[0]}</a>').otherwise(""), F.lit("</body></html>"))
    auth = F.concat(F.lit("mx.example; spf="), F.coalesce("spf", F.lit("none")), F.lit("; dkim="), F.coalesce("dkim", F.lit("none")), F.lit("; dmarc="), F.coalesce("dmarc", F.lit("none")))
    text = F.concat(
        line("From", F.col("mail_from")), line("To", F.lit("desk@org.example")), line("Subject", F.concat(F.lit("=?utf-8?B?"), coded(F.coalesce("subject", F.lit(""))), F.lit("?="))),
        line("Message-ID", F.concat(F.lit("<m"), k.cast("string"), F.lit("@"), F.when(nth(3), "relay.elsewhere.test").otherwise(F.coalesce(H.domain_of("mail_from"), F.lit("x"))), F.lit(">"))), F.when(nth(5), "X-Mailer: Mailchimp Mailer\r\n").otherwise(""),
        line("Authentication-Results", auth), F.lit('MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="b0"\r\n\r\n'), part("Content-Type: text/html; charset=utf-8\r\n", html),
        F.when(nth(7), part('Content-Type: text/html; name="page.html"\r\nContent-Disposition: attachment; filename="page.html"\r\n', F.lit("<html><script>go()</script></html>"))).otherwise(""),
        *(F.when(nth(n), file(name, kind, content)).otherwise("") for n, name, kind, content in ((9, "a.zip", "application/zip", _zip("run.exe")), (10, "b.zip", "application/zip", _zip("plan.txt", True)), (11, "c.docm", "application/octet-stream", _zip("word/vbaProject.bin")), (13, "=?utf-8?B?" + base64.b64encode("bill\u202efdp.exe".encode()).decode() + "?=", "application/octet-stream", "eA=="))),
        F.when(nth(15), F.lit(f"--b0\r\nContent-Type: image/png\r\nContent-Disposition: inline\r\nContent-Transfer-Encoding: base64\r\n\r\n{_png()}\r\n")).otherwise(""),
        F.lit("--b0--\r\n"),
    )
    mails = s.select(k.cast("string").alias("path"), F.lit("eml").alias("kind"), F.encode(text, "utf-8").alias("content"))
    active = F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /OpenAction << /S /JavaScript /JS (go()) >> >> endobj\n%%EOF")
    return mails.unionByName(s.where(nth(8)).select(F.concat(F.lit("pdf"), k.cast("string")).alias("path"), F.lit("pdf").alias("kind"), F.encode(active, "utf-8").alias("content")))


MADE_SQL = "made AS (SELECT * FROM message_summaries WHERE summary_id IS NOT NULL AND mail_from IS NOT NULL QUALIFY row_number() OVER (PARTITION BY summary_id) = 1)"
