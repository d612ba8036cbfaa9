"""Raw messages - RFC 5322, Outlook, plain text, PDF, images - as mail records."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from email.header import decode_header, make_header

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailquern import model
from mailquern.functions import hosts as H
from mailquern.functions.text import detect_language
from mailquern.sources import files
from mailquern.sources.markup import read_html, urls_of

MAX_BODY, MAX_ATTACHMENT, MAX_PARTS, MAX_DEPTH, MAX_LINKS = 4 << 20, 25 << 20, 200, 10, 500
#: Field names that introduce a sender or subject inside pasted text, in English, Russian and Kazakh.
_INLINE_FROM = re.compile(r"(?im)^\s*(?:from|от|от кого|кімнен)\s*:\s*(.+)$")
_INLINE_SUBJECT = re.compile(r"(?im)^\s*(?:subject|тема|тақырып|тақырыбы)\s*:\s*(.+)$")
_HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]*:\s")
_ADDR = re.compile(r"[^\s<>()\"',;:]+@[^\s<>()\"',;:]+")


def kind_of(path: Column, content: Column) -> Column:
    """eml, msg, image, pdf or text by a file's extension, else by its first bytes."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(ext == "eml", "eml").when(ext == "msg", "msg").when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "bmp"), "image").when(ext == "pdf", "pdf").when(ext == "txt", "text")
        .when(head.startswith("D0CF11E0"), "msg").when(head.startswith("89504E47") | head.startswith("FFD8FF") | head.startswith("47494638"), "image").when(head.startswith("25504446"), "pdf").otherwise("eml")
    )


def read_corpus(spark: SparkSession, folder: str, glob: str = "*.{eml,txt,msg,pdf,png}") -> DataFrame:
    """(path, kind, content) of the message files below a folder."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return d.select("path", kind_of(F.col("path"), F.col("content")).alias("kind"), "content")


def header_text(value) -> str:
    try:
        return str(make_header(decode_header(str(value)))).strip()
    except (LookupError, UnicodeError, ValueError):
        return str(value).strip()


def address(value: str) -> dict | None:
    """Display name, address and domain of a header's first address, as far as they can be made out."""
    text = header_text(value)
    if not text:
        return None
    m = re.search(r"<\s*([^<>\s]+@[^<>\s]+)\s*>", text) or _ADDR.search(text)
    if not m:
        return {"display": text, "addr": None, "domain": None}
    addr = (m.group(1) if m.re.groups else m.group()).lower()
    display = re.sub(r"[<>]", "", text.replace(m.group(), "")).strip().strip('"').strip()
    return {"display": display or None, "addr": addr, "domain": addr.rsplit("@", 1)[1].rstrip(".")}


def _time(value: str | None) -> datetime | None:
    try:
        t = email.utils.parsedate_to_datetime(re.sub(r"\([^()]*\)\s*$", "", value or "").strip())
    except (TypeError, ValueError, IndexError):
        return None
    return t.astimezone(timezone.utc) if t.tzinfo else t.replace(tzinfo=timezone.utc)


def hop(raw: str) -> dict:
    text = " ".join(raw.split())
    get = lambda p: m.group(1) if (m := re.search(p, text)) else None
    ip = get(r"\[(?:IPv6:)?([0-9A-Fa-f:.]{3,45})\]") or get(r"\b((?:\d{1,3}\.){3}\d{1,3})\b")
    return {"raw": raw, "from_host": get(r"(?i)\bfrom\s+(\S+)"), "by_host": get(r"(?i)\bby\s+([^\s;]+)"), "ip": ip, "ts": _time(text.rsplit(";", 1)[1]) if ";" in text else None}


def auth_results(values: list[str]) -> dict[str, str]:
    """The first spf, dkim, dmarc and arc result of Authentication-Results lines."""
    out: dict[str, str] = {}
    for v in values:
        for k, r in re.findall(r"\b(spf|dkim|dmarc|arc)=([a-z]+)", v.lower()):
            out.setdefault(k, r)
    return out


def _text(part) -> str:
    raw = part.get_payload(decode=True) or b""
    if len(raw) > MAX_BODY:
        raise ValueError("a body above the size limit")
    for charset in (part.get_content_charset(), "utf-8"):
        try:
            return raw.decode(charset, "replace") if charset else raw.decode("utf-8")
        except (LookupError, UnicodeDecodeError, ValueError):
            pass
    return raw.decode("latin-1")


def _walk(part, out: dict, depth: int = 0) -> None:
    if depth > MAX_DEPTH or out["parts"] >= MAX_PARTS:
        raise ValueError("too many or too deeply nested parts")
    out["parts"] += 1
    kind = part.get_content_type()
    if kind == "message/rfc822" and isinstance(part.get_payload(), list):
        for p in part.get_payload():
            _walk(p, out, depth + 1)
    elif part.is_multipart():
        for p in part.get_payload():
            _walk(p, out, depth + 1)
    else:
        name = header_text(part.get_filename() or "")
        if name or part.get_content_disposition() == "attachment" or not kind.startswith("text/"):
            raw = part.get_payload(decode=True) or b""
            if len(raw) > MAX_ATTACHMENT:
                raise ValueError("an attachment above the size limit")
            if kind == "image/png" and part.get_content_disposition() != "attachment" and (img := files.read_png(raw)):
                out["images"].append(img)
            out["attachments"].append(files.describe(name or f"unnamed.{kind.rsplit('/', 1)[-1]}", kind, raw))
        elif kind == "text/html":
            out["html"].append(_text(part))
        else:
            out["text"].append(_text(part).strip())


def parse_eml(data: bytes) -> dict:
    m = email.message_from_bytes(data, policy=email.policy.compat32)
    out: dict = {"parts": 0, "text": [], "html": [], "attachments": [], "images": []}
    _walk(m, out)
    plain = lambda v: str(v).encode("utf-8", "surrogateescape").decode("utf-8", "replace")  # noqa: E731 - headers may be written in UTF-8 as they stand
    first = lambda k: next((plain(v) for n, v in m.raw_items() if n.lower() == k.lower()), None)
    results = auth_results([str(v) for v in m.get_all("Authentication-Results") or []])
    links = []
    html_text = ""
    for h in out["html"]:
        t, ls = read_html(h)
        html_text = f"{html_text}\n{t}".strip()
        links += ls
    text = "\n\n".join(x for x in out["text"] if x) or html_text
    links += [(u, "") for u in urls_of(text) if u not in {href for href, _ in links}]
    hops = [hop(str(v)) for v in m.get_all("Received") or []]
    date = _time(first("Date")) or next((h["ts"] for h in hops if h["ts"]), None)
    to = email.utils.getaddresses([str(v) for v in m.get_all("To") or []])
    return {
        "from": address(first("From") or ""), "reply_to": address(first("Reply-To") or ""), "return_path": address(first("Return-Path") or ""), "to_count": len(to), "subject": header_text(first("Subject") or "") or None,
        "message_id": str(first("Message-ID") or "").strip() or None, "mailer": f"{first('X-Mailer') or ''} {first('User-Agent') or ''}".strip() or None, "has_headers": bool(m.keys()), "date": date, "text_body": text or None,
        "html_body": "\n".join(out["html"]) or None, "spf": results.get("spf"), "dkim": results.get("dkim"), "dmarc": results.get("dmarc"), "auth_source": "header" if results else None, "received": hops, "links": links[:MAX_LINKS],
        "attachments": out["attachments"], "images": out["images"],
    }


def parse_text(data: bytes) -> dict:
    """Pasted text: a message if two of its first thirty lines are header fields, else a body with perhaps a sender and subject inside."""
    text = data.decode("utf-8-sig", "replace").strip()
    if sum(bool(_HEADER.match(x)) for x in text.split("\n")[:30]) >= 2:
        return parse_eml(text.encode())
    sender, subject = _INLINE_FROM.search(text), _INLINE_SUBJECT.search(text)
    return {"from": address(sender.group(1)) if sender else None, "subject": subject.group(1).strip() if subject else None, "has_headers": False, "text_body": text, "links": [(u, "") for u in urls_of(text)][:MAX_LINKS]}


def parse_msg(data: bytes) -> dict:
    """An Outlook message: its properties by the numbers of their streams."""
    entries = files.cfb_entries(data, whole=True)
    if not entries:
        raise ValueError("no compound file")

    def prop(tag: str, prefix: str = "") -> str:
        if (raw := entries.get(f"{prefix}__substg1.0_{tag}001F")) is not None:
            return raw.decode("utf-16-le", "replace").strip("\0")
        return (entries.get(f"{prefix}__substg1.0_{tag}001E") or b"").decode("utf-8", "replace").strip("\0")

    head = prop("007D")
    base = parse_eml(head.encode()) if head else {}
    html = entries.get("__substg1.0_10130102") or b""
    markup = html.decode("utf-8", "replace")
    html_text, links = read_html(markup) if markup else ("", [])
    text = prop("1000") or html_text
    attached = []
    for name in sorted({e.split("/")[0] for e in entries if e.startswith("__attach_version1.0_")}):
        raw = entries.get(f"{name}/__substg1.0_37010102") or b""
        attached.append(files.describe(prop("3707", f"{name}/") or prop("3704", f"{name}/") or "unnamed", prop("370E", f"{name}/"), raw))
    own = {"from": address(f"{prop('0C1A')} <{prop('5D01') or prop('0C1F')}>"), "subject": prop("0037") or None, "text_body": text or None, "html_body": markup or None, "attachments": attached, "links": [*links, *((u, "") for u in urls_of(text))][:MAX_LINKS], "has_headers": bool(head)}
    return base | {k: v for k, v in own.items() if v}


def parse_pdf(data: bytes) -> dict:
    text, urls, features = files.read_pdf(data)
    return {"has_headers": False, "text_body": text or None, "links": [(u, "") for u in urls][:MAX_LINKS], "pdf": features}


def parse_image(data: bytes) -> dict:
    img = files.read_png(data)
    return {"has_headers": False, "images": [img] if img else [], "links": []}


PARSERS = {"eml": parse_eml, "text": parse_text, "msg": parse_msg, "pdf": parse_pdf, "image": parse_image}
_KEYS = ("from", "reply_to", "return_path", "to_count", "subject", "message_id", "mailer", "has_headers", "date", "text_body", "html_body", "spf", "dkim", "dmarc", "auth_source", "received", "attachments", "images", "pdf")
_RAW = ", ".join([*(f"`{k}` {model.FIELDS[k]}" for k in _KEYS), "links array<struct<href:string,text:string>>", "error string"])


def parse_mail(df: DataFrame, key: str = "path", content: str = "content", kind: str = "kind") -> DataFrame:
    """Mail records, and ``error`` where a message could not be read; such a row is kept with empty fields.

    Null and empty messages are errors, not failures of a task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    raw_schema = StructType.fromDDL(f"msg_id string, {_RAW}")
    arrow = to_arrow_schema(raw_schema)

    def one(k: str, data: bytes | None) -> dict:
        if not data:
            return {"error": "empty message"}
        try:
            out = PARSERS.get(k, parse_eml)(bytes(data))
        except Exception as e:  # noqa: BLE001 - whatever a message holds, its row says so
            return {"error": f"{type(e).__name__}: {e}"[:300]}
        return out | {"links": [{"href": h, "text": t} for h, t in out.get("links", [])]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                rows = [{"msg_id": m} | one(k, c) for m, k, c in zip(*(part.column(j).to_pylist() for j in range(3)))]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], schema=arrow)

    raw = df.select(F.col(key).cast("string"), kind, content).mapInArrow(run, raw_schema)
    return finished(raw)


def classified_links(links: Column) -> Column:
    """Links by what they lead to: without mail, phone, anchor and inline ones, each address once, with host, port and what is odd about it."""
    href = lambda x: F.trim(x["href"])
    own = F.filter(links, lambda x: ~F.lower(href(x)).rlike(r"^(?:mailto:|tel:|#|cid:)") & (href(x) != ""))
    full = F.transform(own, lambda x: F.struct(F.when(F.lower(href(x)).startswith("www."), F.concat(F.lit("http://"), href(x))).otherwise(href(x)).alias("href"), x["text"].alias("text")))
    keys = F.transform(full, lambda x: x["href"])
    once = F.slice(F.filter(full, lambda x, i: F.array_position(keys, x["href"]) == i + 1), 1, MAX_LINKS)

    def made(x: Column) -> Column:
        host = H.url_host(x["href"])
        return F.struct(x["href"].alias("href"), x["text"].alias("text"), host.alias("domain"), H.url_port(x["href"]).alias("port"), (H.is_ipv4(host) | host.startswith("[")).alias("is_ip"), H.is_shortener(host).alias("is_shortener"), H.punycode(host).alias("punycode"), H.anchor_mismatch(x["text"], host).alias("mismatch"))

    return F.transform(once, made)


def finished(raw: DataFrame) -> DataFrame:
    """Parsed fields with links classified and language told, as a mail record."""
    d = raw.withColumn("links", classified_links(F.coalesce("links", F.array().cast("array<struct<href:string,text:string>>"))))
    d = d.withColumn("language", detect_language(F.concat_ws("\n", "subject", "text_body")))
    return model.as_mail(d, "error")


def expanded_links(mail: DataFrame, redirects: DataFrame) -> DataFrame:
    """``mail`` with links to shorteners led on to where a table (url, final_url) says they end."""
    r = redirects.select(F.col("url").alias("href"), "final_url").dropDuplicates(["href"])
    ends = mail.select("msg_id", F.explode(F.transform("links", lambda x: x["href"])).alias("href")).join(r, "href").groupBy("msg_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("href", "final_url")))).alias("__ends"))
    end = lambda x: F.coalesce(F.try_element_at(F.col("__ends"), x["href"]), x["href"])
    return mail.join(ends, "msg_id", "left").withColumn("links", F.when(F.col("__ends").isNull(), F.col("links")).otherwise(F.transform("links", lambda x: x.withField("href", end(x)).withField("domain", H.url_host(end(x)))))).drop("__ends")
