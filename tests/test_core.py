import io
import struct
import zipfile
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mailquern import refdata
from mailquern.functions import hosts as H, text as T
from mailquern.operators import analytics as A, brands as B, checks as C, evaluate as E, export as X, lookups as L, opinions as O, score as S, timestamps as TS
from mailquern.sources import files, mail as M


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_hosts(spark):
    d = spark.createDataFrame([("mail.kaspi.co.uk",), ("a.b.example.com",), ("localhost",), (None,)], "h string")
    assert [r[0] for r in rows(d.select(H.registrable_domain(F.col("h"))))] == ["kaspi.co.uk", "example.com", "localhost", None]
    ips = spark.createDataFrame([(x,) for x in ("10.1.2.3", "172.16.0.1", "172.32.0.1", "8.8.8.8", "::1", "fe80::1", "2001:db8::1", "x", None)], "ip string")
    assert [r[0] for r in rows(ips.select(H.is_private_ip(F.col("ip"))))] == [True, True, False, False, True, True, False, False, False]
    u = spark.createDataFrame([("https://user@Evil.Example.:8443/x",), ("ftp://h/",), ("nothing",)], "u string")
    assert rows(u.select(H.url_host(F.col("u")), H.url_port(F.col("u")))) == [("evil.example", "8443"), ("h", ""), ("", "")]
    tags = spark.createDataFrame([("v=DMARC1; p=reject; p=none",), ("junk",)], "r string").select(H.dmarc_tags(F.col("r")))
    assert [r[0] for r in rows(tags)] == [{"v": "DMARC1", "p": "reject"}, {}]


def test_psl(tmp_path, spark):
    p = tmp_path / "list"
    p.write_text("// comment\ncom\nuk\nco.uk\n*.ck\n!www.ck\ngithub.io\n")
    d = spark.createDataFrame([(x,) for x in ("a.b.co.uk", "co.uk", "x.y.ck", "a.x.y.ck", "www.ck", "me.github.io", "a.unknown")], "h string")
    assert [r[0] for r in rows(d.select(H.psl_registrable_domain(str(p))(F.col("h"))))] == ["b.co.uk", "co.uk", "x.y.ck", "x.y.ck", "www.ck", "me.github.io", "a.unknown"]


@pytest.mark.parametrize("text,lang", [("Срочно подтвердите перевод", "ru"), ("Please verify your account now", "en"), ("Шұғыл: деректерді растаңыз", "kz"), ("12345 !!!", ""), (None, "")])
def test_language(spark, text, lang):
    assert rows(spark.createDataFrame([(text,)], "t string").select(T.detect_language(F.col("t")))) == [(lang,)]


def test_numbers(spark):
    d = spark.createDataFrame([("970514452252",), ("970514452253",), ("000000000000",), ("12",), (None,)], "s string")
    assert [r[0] for r in rows(d.select(T.valid_kz_identifier(F.col("s"))))] == [True, False, False, False, False]
    d = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("1",), (None,)], "s string")
    assert [r[0] for r in rows(d.select(T.luhn_ok(F.col("s"))))] == [True, False, False, False]


@pytest.mark.parametrize("a,b,d", [("kaspi", "kapsi", 1), ("kaspi", "kaspii", 1), ("kaspi", "kasp", 1), ("paypal", "paypa1", 1), ("kaspi", "halyk", 4), ("", "abc", 3), ("ca", "abc", 3)])
def test_osa(a, b, d):
    assert B.osa_distance(a, b) == B.osa_distance(b, a) == d


@given(st.text(max_size=8), st.text(max_size=8))
@settings(max_examples=60, deadline=None)
def test_osa_is_symmetric(a, b):
    assert B.osa_distance(a, b) == B.osa_distance(b, a) <= max(len(a), len(b))


def _brands(spark):
    rows_ = [("Kaspi", ["kaspi.kz"], ["notify.kaspi.net"], ["kaspi"], "kz", [], None, "", 0), ("PayPal", ["paypal.com"], [], ["paypal"], "global", [], None, "", 1), ("Microsoft", ["microsoft.com"], [], ["microsoft", "office"], "global", [], None, "", 2)]
    return spark.createDataFrame(rows_, B.SCHEMA)


def test_brand_hosts(spark):
    hosts = ["kaspi.kz", "mail.kaspi.kz", "x.notify.kaspi.net", "kaspi-secure-login.com", "kaspii.kz", "paypa1.com", "micros0ft.com", "kаspi.kz", "gmail.com", None]
    got = {r.host: r for r in B.match_hosts(spark.createDataFrame([(h,) for h in hosts], "host string"), _brands(spark)).collect()}
    assert {h for h in got if got[h].official} == {"kaspi.kz", "mail.kaspi.kz", "x.notify.kaspi.net"}
    assert got["kaspi-secure-login.com"].method == "typosquat" and got["kaspii.kz"].name == "Kaspi" and round(got["kaspii.kz"].score, 3) == 0.8
    assert got["kаspi.kz"].method == got["paypa1.com"].method == got["micros0ft.com"].method == "homoglyph"
    assert "gmail.com" not in got


def _signals(*sigs):
    return [{"id": i, "category": i.split(".")[0], "weight": float(w), "confidence": float(c), "evidence": "", "source": s} for i, w, c, s in sigs]


SCHEMA = "msg_id string, signals array<struct<id:string,category:string,weight:double,confidence:double,evidence:string,source:string>>, llm struct<verdict_opinion:string,attack_type:string,recommended_action:string,highlights:int>"


@pytest.mark.parametrize("sigs,opinion,score,verdict", [
    ([("a.b", 30, 1, "heuristic"), ("a.c", 10, 0.5, "heuristic")], None, 35, "clean"), ([("a.b", 30, 1, "heuristic"), ("a.c", 20, 1, "heuristic")], None, 50, "suspicious"), ([("a.b", 90, 1, "heuristic"), ("a.c", 90, 1, "heuristic")], None, 100, "phishing"),
    ([("a.b", -40, 1, "heuristic")], None, 0, "clean"), ([("reputation.org_blocklist", 100, 1, "heuristic"), ("a.b", -40, 1, "heuristic")], None, 70, "phishing"), ([("reputation.domain_listed", 5, 1, "ti")], None, 40, "suspicious"),
    ([("auth.dmarc_fail", 25, 1, "heuristic"), ("link.ip_host", 20, 1, "heuristic")], "clean", 45, "needs_review"), ([("reputation.org_allowlist", -30, 1, "heuristic"), ("a.b", 60, 1, "heuristic"), ("a.c", 50, 1, "heuristic")], None, 80, "needs_review"), (None, None, 0, "clean"),
])
def test_score(spark, sigs, opinion, score, verdict):
    llm = None if opinion is None else (opinion, None, None, 0)
    r = S.score_messages(spark.createDataFrame([("m", None if sigs is None else _signals(*sigs), llm)], SCHEMA)).first()
    assert (r.score, r.verdict) == (score, verdict) and 0.1 <= r.confidence <= 0.99


def test_every_check_has_a_weight():
    assert set(C.CHECKS) == set(refdata.WEIGHTS) and len(C.CHECKS) == 65


EML = b"""Received: from mx.evil.example (mx.evil.example [10.0.0.7]) by in.example; Tue, 2 Apr 2024 10:00:00 +0500
Authentication-Results: in.example; spf=fail; dkim=none; dmarc=fail
From: "Kaspi Bank" <security@kaspi-secure-login.com>
Reply-To: a@other.example
Return-Path: <b@third.example>
To: u@org.example
Subject: =?utf-8?b?0KHRgNC+0YfQvdC+?=
Date: Tue, 02 Apr 2024 10:00:00 +0500
Message-ID: <1@kaspi-secure-login.com>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/html; charset=utf-8

<p>Act now, password expires</p><a href="http://1.2.3.4/x">https://kaspi.kz</a><img width=1 height=1>
--b
Content-Type: application/octet-stream; name="invoice.pdf.exe"
Content-Disposition: attachment; filename="invoice.pdf.exe"
Content-Transfer-Encoding: base64

TVo=
--b--
"""


def _parsed(spark, *data):
    return M.parse_mail(spark.createDataFrame([(f"m{i}", k, d) for i, (k, d) in enumerate(data)], "path string, kind string, content binary"))


def test_parse_and_detect(spark):
    mail = _parsed(spark, ("eml", bytearray(EML)))
    r = mail.first()
    assert r["from"].domain == "kaspi-secure-login.com" and r.subject == "Срочно" and r.spf == "fail" and r.error is None and r.received[0].ip == "10.0.0.7"
    assert [x.ext for x in r.attachments] == ["exe"] and r.links[0].is_ip and "Act now" in r.text_body
    d = C.detect(L.with_lookups(mail, brands=_brands(spark)))
    ids = {s.id for s in d.first().signals}
    assert {"header.replyto_mismatch", "header.returnpath_mismatch", "auth.spf_fail", "auth.dmarc_fail", "domain.brand_lookalike", "brand.sender_mismatch", "link.ip_host", "link.tracking_pixel", "attachment.dangerous_ext", "attachment.double_ext", "content.urgency", "content.credential_request", "header.received_private_ip"} <= ids
    assert S.score_messages(d).first().verdict == "phishing"


def test_bad_messages_are_rows(spark):
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("run.exe", b"x")
    got = _parsed(spark, ("eml", None), ("msg", bytearray(b"\xd0\xcf\x11\xe0 broken")), ("eml", bytearray(b"\xff\xfe\x00")), ("pdf", bytearray(b"%PDF /JavaScript (hello) Tj http://a.example/x")), ("text", bytearray("От: a@b.example\nТема: счёт\nтекст www.x.example.".encode()))).collect()
    assert got[0].error == "empty message" and got[1].error.startswith("ValueError") and got[3].pdf.javascript and got[3].links[0].domain == "a.example"
    assert got[4].subject == "счёт" and got[4].links[0].domain == "www.x.example"
    d = files.describe("a.zip", "application/zip", zipped.getvalue())
    assert d["is_archive"] and d["nested_names"] == ["run.exe"]


@given(st.binary(max_size=300))
@settings(max_examples=80, deadline=None)
def test_parsers_never_break_a_file_reader(data):
    files.describe("x", "", data)
    files.read_pdf(data)
    files.read_png(b"\x89PNG\r\n\x1a\n" + data)
    files.cfb_entries(files.CFB + data)


@pytest.mark.parametrize("text,want", [
    ("2024-04-02T19:09:47Z", (1712084987, False, None, False)), ("20240402T205621Z", (1712091381, False, None, False)), ("1712162077708", (1712162077, False, None, False)), ("1712028808157537", (1712028808, False, None, False)),
    ("02.04.2024 11:35", (1712057700, True, None, True)), ("04/02/2024 12:22:37 AM", (1712017357, True, None, False)), ("Tue, 2 Apr 2024 10:07:54 +0530 (local)", (1712032674, False, None, False)), ("Tue, 02 Apr 2024 07:07:01 EDT", (1712056021, False, None, False)),
    ("2024-04-05T23:39:24[America/New_York]", (1712360364, True, "America/New_York", False)), ("2024-04-02 07:44:29 UTC+05:00", (1712025869, False, None, False)), ("Wed Apr 10 11:55:29 2024", (1712750129, True, None, False)),
    ("", (None,) * 4), ("unknown", (None,) * 4), ("31.02.2024 10:00", (None,) * 4), ("2024-13-01 10:00:00", (None,) * 4), (None, (None,) * 4), ("  2024-04-02\t19:09:47.123456789+0000 ", (1712084987, False, None, False)),
])
def test_parse_time(text, want):
    assert TS.parse_text(text) == want


def test_instants_and_zones(spark):
    ny = ZoneInfo("America/New_York")
    base = datetime(2024, 11, 1, 12, tzinfo=timezone.utc)
    made = []
    for i in range(60):
        t = base + timedelta(hours=i)
        made.append((f"s{i}", "o1", t.astimezone(ny).strftime("%Y-%m-%d %H:%M:%S"), (t + timedelta(seconds=30)).replace(tzinfo=None)))
    made += [("gap", "o1", "2024-03-10 02:30:00", base.replace(tzinfo=None)), ("twice", "o1", "2024-11-03 01:30:00", base.replace(tzinfo=None)), ("none", "o1", "n/a", None), (None, "o1", "x", None), ("s0", *made[0][1:])]
    subs = spark.createDataFrame(made, "submission_id string, org_id string, received_at string, created_at timestamp_ntz")
    orgs = spark.createDataFrame([], "org_id string, tz_name string")
    got = {r.submission_id: r for r in TS.normalised_submissions(subs, orgs).collect()}
    assert len(got) == 63 and got["gap"].meant == [] and len(got["twice"].meant) == 2 and got["none"].meant is None
    assert all(int((base + timedelta(hours=i)).timestamp()) in got[f"s{i}"].meant for i in range(60))
    wrong = spark.createDataFrame([("o1", "Asia/Tashkent")], "org_id string, tz_name string")
    again = TS.normalised_submissions(subs, wrong).where("submission_id = 's5'").first()
    assert int((base + timedelta(hours=5)).timestamp()) in again.meant
    empty = TS.normalised_submissions(subs.limit(0), orgs)
    assert empty.count() == 0


def test_lists_and_caches(spark):
    mail = _parsed(spark, ("eml", bytearray(EML))).withColumn("org_id", F.lit("o"))
    lists = spark.createDataFrame([("", "allow", "kaspi-secure-login.com"), ("o", "block", "Other.example."), ("else", "block", "third.example")], "org_id string, kind string, value string")
    r = L.list_hits(mail, lists).first()
    assert r.block_hit == "other.example" and r.allow_hit == "kaspi-secure-login.com"
    cache = spark.createDataFrame([("k", 1, 10), ("k", 2, 5), ("k", 3, 20)], "k string, put int, until int")
    assert rows(A.live_cache(cache, "k", "put", "until", F.lit(9)).select("put")) == [(3,)]
    log = spark.createDataFrame([("s", datetime(2024, 1, 1, 0, 0, s), ok) for s, ok in ((0, False), (1, False), (2, False), (3, True), (40, True))], "s string, t timestamp, ok boolean")
    assert [r[0] for r in rows(A.breaker_states(log, "s", "t", "ok").orderBy("t").select("open"))] == [False, False, False, True, False]


def test_upsert_and_insert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, v string")
    assert sorted(rows(A.upserted(t, c.distinct(), "k"))) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(rows(A.inserted(t, c, "k"))) == [(1, "a"), (2, "b"), (3, "y")]
    with pytest.raises(ValueError):
        A.set_status(t, [], "x")


def test_opinions(spark):
    raws = ['```json {"verdict_opinion":"phishing","attack_type":"bec","summary":"s","tactics":["urgency","magic"]} ```', '{"verdict_opinion":"maybe","summary":"s"}', '{"verdict_opinion":"clean","summary":" "}', "prose", '{"verdict_opinion":"clean","summary":"x"}', None]
    got = [r.opinion for r in O.parsed_opinions(spark.createDataFrame([(r,) for r in raws], "raw string"), "raw").collect()]
    assert got[0].tactics == ["urgency"] and got[4].attack_type == "none" and [g is None for g in got] == [False, True, True, True, False, True]


def test_redact():
    t = "Write a.b@c.example or A.B@C.EXAMPLE, card 4111 1111 1111 1111, run 1234567890123, IIN 970514452252, call +7 701 111 22 33."
    r = O.redact(t)
    assert r == "Write [EMAIL_1]@c.example or [EMAIL_2]@C.EXAMPLE, card [CARD_1], run 1234567890123, IIN [IIN_1], call [PHONE_1]." and O.redact(None) is None


def test_redact_names_each_original():
    r = O.redact("Пишет Анна <a.berg@company.kz>, тел 7 701 123 45 67, ИИН 900101300123, карта 4111 1111 1111 1111, IBAN KZ86125KZT5004100100, ещё 1234567890123")
    assert r == "Пишет Анна <[EMAIL_1]@company.kz>, тел [PHONE_1], ИИН [IIN_1], карта [CARD_1], IBAN [IBAN_1], ещё 1234567890123"


def test_tune(spark):
    ex = spark.createDataFrame([("phishing", {"content.credential_request": 1.0})] * 4 + [("clean", {"auth.spf_fail": 1.0})] * 4, "label string, signals map<string,double>")
    w = E.tuned_weights(ex, refdata.WEIGHTS)
    assert w["content.credential_request"] > 20 and w["auth.spf_fail"] < 20 and w["link.ip_host"] == 20
    with pytest.raises(Exception, match="unknown label"):
        E.tuned_weights(spark.createDataFrame([("what", {"a": 1.0})], ex.schema), refdata.WEIGHTS)


def test_reports(spark):
    md = X.report(spark.createDataFrame([("verdict", "phishing", 2), ("verdict", "clean", 1), ("department", "<hr>", 3)], "dimension string, value string, n long"))
    assert md.decode().index("clean") < md.decode().index("phishing")
    assert b"&lt;hr&gt;" in X.REPORTS["html"]("- <hr>") and X.REPORTS["pdf"]("# a(b)").startswith(b"%PDF") and zipfile.ZipFile(io.BytesIO(X.REPORTS["docx"]("x"))).namelist()
    assert X.signed("s", "1", "b").startswith("sha256=")


def test_streams(spark, tmp_path):
    from mailquern.streaming import jobs

    src = tmp_path / "in"
    e = spark.createDataFrame([(1, "m1", "new", datetime(2024, 1, 1)), (1, "m1", "new", datetime(2024, 1, 1)), (2, "m1", "done", datetime(2024, 1, 2)), (3, "m2", "new", datetime(2024, 1, 9))], "no int, k string, status string, t timestamp")
    e.write.parquet(str(src))
    stream = jobs.table_stream(spark, str(src), e.schema, 10)
    q = jobs.tumbling_counts(jobs.deduplicated(stream, ["no"], "t"), "t", "status", delay=None).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.status, r.n) for r in spark.table("counts").collect()} >= {("new", 1), ("done", 1)}
    q = jobs.into_table(stream, str(tmp_path / "t"), str(tmp_path / "cp"), "k", "t").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.status) for r in jobs.current_table(spark, str(tmp_path / "t")).collect()) == [("m1", "done"), ("m2", "new")]


def compound_file(content: bytes, listed: bool = True) -> bytes:
    """A compound file of 512-byte sectors with one large stream; ``listed``: the FAT's sectors past the 109th are named."""
    n = -(-len(content) // 512)
    fats = -(-(n + 200) // 128)
    difats = -(-(fats - 109) // 127)
    fat = [0xFFFFFFFE, *range(2, n + 1), 0xFFFFFFFE, *[0xFFFFFFFD] * fats, *[0xFFFFFFFC] * difats]
    fat += [0xFFFFFFFF] * (fats * 128 - len(fat))
    places = list(range(n + 1, n + 1 + fats))
    record = lambda name, kind, child, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + bytes(36) + struct.pack("<IQ", start, size)
    directory = record("Root Entry", 5, 1, 0xFFFFFFFE, 0) + record("big", 2, 0xFFFFFFFF, 1, len(content)) + bytes(256)
    more = places[109:] + [0xFFFFFFFF] * (difats * 127 - len(places[109:]))
    chain = b"".join(struct.pack("<128I", *more[i * 127 : (i + 1) * 127], n + 2 + fats + i if i + 1 < difats else 0xFFFFFFFE) for i in range(difats))
    head = files.CFB + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, fats, 0, 0, 4096, 0xFFFFFFFE, 0, n + 1 + fats if listed else 0xFFFFFFFE, difats, places[0])
    head = head[:76] + struct.pack("<109I", *places[:109])
    return head + directory + content.ljust(n * 512, b"\0") + struct.pack(f"<{len(fat)}I", *fat) + chain


def test_large_compound_file():
    content = bytes(range(251)) * 65_000  # 16 MB: two DIFAT sectors
    assert files.cfb_entries(compound_file(content), whole=True) == {"big": content}
    broken = compound_file(content, listed=False)
    assert len(files.cfb_entries(broken)["big"]) < len(content)
    with pytest.raises(files.CutShort):
        files.cfb_entries(broken, whole=True)
    with pytest.raises(files.CutShort):
        M.parse_msg(broken)


def test_long_report_has_all_lines():
    pdf = X.report_pdf("\n".join(f"line {i}" for i in range(120)))
    assert all(f"(line {i}) Tj".encode() in pdf for i in range(120)) and pdf.count(b"/Type /Page /") == 3 and b"/Count 3" in pdf


def test_all_keywords_are_matched(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 2)
    brands = spark.createDataFrame([(w, [], [], [w], "global", [], None, "", i) for i, w in enumerate("amber birch cedar delta ember".split())], B.SCHEMA)
    texts = spark.createDataFrame([(i, f"The {w} shop") for i, w in enumerate("AMBER birch cedar delta ember none".split())], "k long, t string")
    got = sorted((r.k, r.name, r.score) for r in B.match_texts(texts, "k", "t", brands).collect())
    assert got == [(i, w, 0.5) for i, w in enumerate("amber birch cedar delta ember".split())]
    assert B.match_texts(texts, "k", "t", brands.limit(0)).count() == 0


def test_offset_histories():
    edges, offsets, names = TS.offset_histories()
    at = lambda zone, t: int(offsets[next(i for i, n in enumerate(names) if zone in n), max(0, edges.searchsorted(t, side="right") - 1)])
    assert at("Europe/Berlin", 1_711_846_799) == 4 and at("Europe/Berlin", 1_711_846_800) == 8  # 31 March 2024, 01:00 UTC
    assert at("Asia/Kathmandu", 1_700_000_000) == 23 and at("UTC", 0) == 0


@pytest.mark.parametrize("declared,expected", [("Europe/Berlin", "Europe/Berlin"), (None, None), ("Asia/Tokyo", None), ("Not/AZone", None)])
def test_estimation_decides(spark, declared, expected):
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    start = datetime(2024, 1, 1, tzinfo=ZoneInfo("UTC"))
    rows = []
    for k in range(366):
        u = start + timedelta(days=k, hours=5)
        clock = u.astimezone(ZoneInfo("Europe/Berlin")).replace(tzinfo=ZoneInfo("UTC"))
        rows.append(("h", int(clock.timestamp()), int(u.timestamp()) + 30, 60, 900))
    rows += [("h", 5, 99999999, 60, 900), (None, 5, 5, 60, 900), ("few", 5, 5, 60, 900)]
    spoken = spark.createDataFrame(rows, "group string, secs long, aligned long, early int, late int")
    told = spark.createDataFrame([("h", declared), ("few", "Asia/Almaty"), ("silent", "UTC"), (None, "UTC")], "host string, tz string")
    got = {r.group: r.zone for r in TS.estimate_zones(spoken, told).collect()}
    assert set(got) == {"h", "few", "silent"} and got["few"] == "Asia/Almaty" and got["silent"] == "UTC"
    z = ZoneInfo(got["h"])
    assert expected is None or got["h"] == expected
    assert all((start + timedelta(hours=5 * k)).astimezone(z).utcoffset() == (start + timedelta(hours=5 * k)).astimezone(ZoneInfo("Europe/Berlin")).utcoffset() for k in range(1750))


def test_hops_without_zones_go_by_sequence(spark):
    hops = [(i * 2, f"s{i}", 2, "known", f"2024-05-{1 + i % 28:02d}T10:00:00Z", None) for i in range(40)] + [(i * 2 + 1, f"s{i}", 1, "silent", f"2024-05-{1 + i % 28:02d} 15:03:00", None) for i in range(40)]
    d = spark.createDataFrame(hops, "hop_id long, submission_id string, hop_no int, by_host string, hop_ts string, hop_raw string")
    hosts = spark.createDataFrame([("silent", None)], "host_name string, tz_name string")
    got = {r.hop_id: r.noted_meant for r in TS.normalised_hops(d, hosts).collect()}
    assert all(got[i * 2 + 1][0] - got[i * 2][0] == 180 for i in range(40))
