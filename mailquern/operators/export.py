"""What leaves the engine: indicators, events, reports, metrics."""

from __future__ import annotations

import hashlib
import hmac
import html
import io
import json
import zipfile

from pyspark.sql import Column, DataFrame, functions as F

from mailquern import refdata


def quoted(value: Column) -> Column:
    """A value inside single quotes of a pattern."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def stix_pattern(kind: Column, value: Column) -> Column:
    v = quoted(value)
    return F.when(kind == "domain", F.concat(F.lit("[domain-name:value = '"), v, F.lit("']"))).when(kind == "url", F.concat(F.lit("[url:value = '"), v, F.lit("']"))).when(kind == "sha256", F.concat(F.lit("[file:hashes.'SHA-256' = '"), v, F.lit("']")))


def stix_indicators(iocs: DataFrame, created: str = "created_at") -> DataFrame:
    """(value): one STIX 2.1 indicator in JSON for each indicator of a known kind; its id follows from kind and value."""
    h = F.sha2(F.concat_ws("\x1f", "ioc_kind", "ioc_value"), 256)
    uid = F.concat(F.lit("indicator--"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    at = F.date_format(F.col(created), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    p = stix_pattern(F.col("ioc_kind"), F.col("ioc_value"))
    return iocs.where(p.isNotNull()).select(F.to_json(F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), uid.alias("id"), at.alias("created"), at.alias("modified"), F.lit("stix").alias("pattern_type"), p.alias("pattern"), at.alias("valid_from"))).alias("value"))


def misp_type(kind: Column) -> Column:
    return F.when(kind == "domain", "domain").when(kind == "url", "url").when(kind == "sha256", "sha256")


def misp_attributes(iocs: DataFrame) -> DataFrame:
    """(value): one MISP attribute in JSON for each indicator of a known kind."""
    k = misp_type(F.col("ioc_kind"))
    category = F.when(k == "sha256", "Payload delivery").otherwise("Network activity")
    return iocs.where(k.isNotNull()).select(F.to_json(F.struct(k.alias("type"), category.alias("category"), F.col("ioc_value").alias("value"), F.lit(True).alias("to_ids"))).alias("value"))


def verdict_rank(verdict: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for i, v in enumerate(refdata.VERDICTS) for x in (v, i)))
    return F.coalesce(F.try_element_at(ranks, verdict), F.lit(-1))


def events(analyses: DataFrame, kind: str = "analysis", at_least: str = "clean") -> DataFrame:
    """Events that name no person: ids, verdict, score, signal ids, domains and hashes, from a verdict on."""
    ids = F.transform("signals", lambda s: s["id"])
    return analyses.where(verdict_rank(F.col("verdict")) >= refdata.VERDICTS.index(at_least)).select(
        F.lit(kind).alias("event_type"), "msg_id", "org_id", "verdict", "score", "confidence", "attack_type", F.col("brand.name").alias("brand"), F.col("from.domain").alias("sender_domain"), F.col("reply_to.domain").alias("reply_domain"),
        F.array_distinct(F.filter(F.transform("links", lambda x: x["domain"]), lambda h: h.isNotNull() & (h != ""))).alias("link_domains"), F.transform("attachments", lambda x: x["sha256"]).alias("attachment_sha256"), ids.alias("signals"),
    )


def signed(secret: str, timestamp: str, body: str) -> str:
    """The signature a webhook carries."""
    return "sha256=" + hmac.new(secret.encode(), f"{timestamp}.{body}".encode(), hashlib.sha256).hexdigest()


def payloads(evts: DataFrame, target: str) -> DataFrame:
    """(msg_id, body): an event as the JSON that a ticket or case system takes; delivery is the caller's ``foreachBatch``."""
    title = F.concat(F.lit("Suspicious mail: "), "verdict", F.lit(", score "), F.col("score").cast("string"))
    severity = F.when(F.col("verdict") == "phishing", 3).when(F.col("verdict").isin("suspicious", "needs_review"), 2).otherwise(1)
    shapes = {
        "webhook": F.struct(*evts.columns), "siem": F.struct(F.lit("mail-analysis").alias("integration"), F.struct(*evts.columns).alias("event")),
        "case": F.struct(title.alias("title"), severity.alias("severity"), F.array(F.lit("phishing"), F.col("attack_type")).alias("tags"), F.to_json("signals").alias("description")),
        "ticket": F.struct(F.struct(title.alias("summary"), F.array_join("signals", "\n").alias("description"), F.struct(F.lit("Task").alias("name")).alias("issuetype")).alias("fields")),
    }
    return evts.select("msg_id", F.to_json(shapes[target]).alias("body"))


BUCKETS = (0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)


def metric_counts(analyses: DataFrame) -> DataFrame:
    """(channel, kind, verdict, n): the counters of analyses."""
    return analyses.groupBy("channel", "kind", "verdict").agg(F.count("*").alias("n"))


def stage_histogram(stages: DataFrame, stage: str, seconds: str) -> DataFrame:
    """(stage, le, n): cumulative counts of durations by the fixed bounds; the last is infinite."""
    bounds = [*BUCKETS, float("inf")]
    c = stages.groupBy(stage).agg(*(F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    return c.select(stage, F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))).alias("x")).select(stage, "x.le", "x.n")


def report_markdown(counts: dict[str, dict[str, int]], avg_ms: int = 0, review_ms: int = 0) -> str:
    """A report of a few counts: verdicts in their order, other dimensions by name."""
    out = ["# Report", ""]
    for dim in sorted(counts, key=lambda d: (d != "verdict", d)):
        order = refdata.VERDICTS if dim == "verdict" else []
        rows = sorted(counts[dim].items(), key=lambda kv: (order.index(kv[0]) if kv[0] in order else len(order), kv[0]))
        out += [f"## {dim}", "", *(f"- {k}: {v}" for k, v in rows), ""]
    return "\n".join([*out, f"Mean analysis time: {avg_ms} ms", f"Mean review time: {review_ms} ms", ""])


def report_html(markdown: str) -> str:
    rows = [f"<h2>{html.escape(x[3:])}</h2>" if x.startswith("## ") else f"<h1>{html.escape(x[2:])}</h1>" if x.startswith("# ") else f"<p>{html.escape(x)}</p>" for x in markdown.split("\n") if x]
    return '<!doctype html><meta charset="utf-8"><main>' + "".join(rows) + "</main>"


def report_docx(markdown: str) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{html.escape(x)}</w:t></w:r></w:p>' for x in markdown.split("\n"))
    ns = "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{ns}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return buf.getvalue()


def report_pdf(markdown: str) -> bytes:
    """Plain ASCII lines, 52 a page."""
    lines = [x.encode("ascii", "replace").decode().replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") for x in markdown.split("\n")]
    pages = [lines[i : i + 52] for i in range(0, len(lines), 52)]
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, page in enumerate(pages):
        stream = "BT /F1 10 Tf 50 790 Td 14 TL " + " ".join(f"({x}) Tj T*" for x in page) + " ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents {5 + 2 * i} 0 R /Resources << /Font << /F1 3 0 R >> >> >>", f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream"]
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n{o}\nendobj\n".encode()
    xref = len(out)
    return out + (f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n" + "".join(f"{a:010d} 00000 n \n" for a in at) + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{xref}\n%%EOF").encode()


REPORTS = {"md": lambda m: m.encode(), "html": lambda m: report_html(m).encode(), "docx": report_docx, "pdf": report_pdf, "json": lambda m: json.dumps({"report": m}).encode()}


def report(stats: DataFrame, form: str = "md") -> bytes:
    """A report of (dimension, value, n) rows, which are few."""
    counts: dict[str, dict[str, int]] = {}
    for dim, value, n in stats.select("dimension", "value", "n").collect():
        counts.setdefault(dim, {})[value] = n
    return REPORTS[form](report_markdown(counts))
