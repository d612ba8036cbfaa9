import base64
import json

import pytest
from pyspark.sql import functions as F

from mailquern import model
from mailquern.functions import hosts as H, text as T
from mailquern.operators import authcheck, brands as B, lookups as L, review
from mailquern.sources import requests as Q


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_requests(spark):
    eml = base64.b64encode(b"From: a@b.example\r\n\r\nx").decode()
    bodies = [{"eml_base64": eml, "text": "x"}, {"text": " hi ", "channel": "web", "no_llm": True}, {"image_base64": "@@"}, {}, {"text": "  "}]
    d = spark.createDataFrame([*((i, json.dumps(b)) for i, b in enumerate(bodies)), (5, "no json"), (6, None), (7, "")], "id int, body string")
    got = {r.id: r for r in Q.analyse_requests(d, "id", "body").collect()}
    assert got[0].kind == "eml" and bytes(got[0].content).startswith(b"From:") and got[0].channel == "api" and got[0].error is None
    assert bytes(got[1].content) == b" hi " and got[1].no_llm and got[1].channel == "web"
    assert [bool(got[i].error) for i in range(8)] == [False, False, True, True, True, True, True, True] and got[2].content is None


def test_lines(spark, tmp_path):
    (tmp_path / "labels.jsonl").write_text('{"label":" Phish ","signals":{"a":1.0}}\n\n{"label":"clean","signals":{"b":0.5}}\n')
    assert sorted(r.target for r in Q.read_labels(spark, str(tmp_path / "labels.jsonl")).collect()) == [0.0, 100.0]
    (tmp_path / "bad.jsonl").write_text('{"label":"odd","signals":{"a":1.0}}\n')
    with pytest.raises(Exception, match="unknown label"):
        Q.read_labels(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "pilot.jsonl").write_text('{"id":"1","predicted":"clean","actual":"phishing"}\n')
    assert Q.read_pilot(spark, str(tmp_path / "pilot.jsonl")).first().actual == "phishing"
    Q.write_results(spark.createDataFrame([("m", "clean", 3)], "msg_id string, verdict string, score int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().file == "m"


def test_review(spark):
    s = spark.createDataFrame([("a", "o1", "new", None), ("b", "o1", "new", None), ("c", "o2", "new", None)], "submission_id string, org_id string, review_status string, reviewed_by string")
    orders = spark.createDataFrame([("a", "confirmed_clean", "x", 1), ("a", "escalated", "y", 2), ("zz", "escalated", "y", 2), ("b", "odd", "y", 2)], "submission_id string, status string, actor string, decided_at int")
    d, audit = review.reviewed(s, orders)
    assert rows(d.select("submission_id", "review_status", "reviewed_by"))[0] == ("a", "escalated", "y") and rows(audit.select("action", "details")) == [("incident.create", ""), ("submission.review", "confirmed_clean")]
    d, audit = review.bulk_reviewed(s, ["a", " b "], "in_review", "me", "o1")
    assert audit.count() == 2 and d.where("review_status = 'in_review'").count() == 2
    for bad in (([], "in_review", "o1"), (["a"] * 101, "in_review", "o1"), (["a", ""], "in_review", "o1"), (["a"], "odd", "o1")):
        with pytest.raises(ValueError):
            review.bulk_reviewed(s, bad[0], bad[1], "me", bad[2])
    with pytest.raises(LookupError):
        review.bulk_reviewed(s, ["a", "c"], "in_review", "me", "o1")
    entries, audit, refused = review.blocked_domains(s, spark.createDataFrame([("a", " Evil.example "), ("b", "10.0.0.1"), ("c", "a/b"), ("c", None), ("none", "x.example")], "submission_id string, domain string").withColumn("actor", F.lit("me")))
    assert rows(entries.select("org_id", "value")) == [("o1", "evil.example")] and audit.count() == 1 and refused.count() == 4


def _mail(spark, *mails):
    d = spark.createDataFrame([(m, sender, back, [ip] if ip else []) for m, sender, back, ip in mails], "msg_id string, sender string, back string, ips array<string>")
    address = lambda c: F.struct(F.lit(None).cast("string").alias("display"), F.lit(None).cast("string").alias("addr"), F.col(c).alias("domain"))
    hops = F.transform("ips", lambda i: F.struct(*(F.lit(None).cast("string").alias(n) for n in ("raw", "from_host", "by_host")), i.alias("ip"), F.lit(None).cast("timestamp").alias("ts")))
    return model.as_mail(d.select("msg_id", address("sender").alias("from"), address("back").alias("return_path"), hops.alias("received")))


def test_own_authentication(spark):
    mail = _mail(spark, ("ok", "example.com", "example.com", "203.0.113.9"), ("bad", "example.com", None, "203.0.113.10"), ("open", "plain.example", None, "203.0.113.9"), ("inc", "sub.host.example", None, "198.51.100.77"), ("soft", "host.example", None, "192.0.2.1"), ("noip", "example.com", None, None), ("far", "example.com", "host.example", "198.51.100.77"))
    records = spark.createDataFrame([("example.com", "v=spf1 ip4:203.0.113.9 -all"), ("_dmarc.example.com", "v=DMARC1; p=reject"), ("host.example", "v=spf1 include:_net.example ~all"), ("sub.host.example", "v=spf1 redirect=host.example"), ("_net.example", "v=spf1 ip4:198.51.100.0/24 -all"), ("_dmarc.host.example", "v=DMARC1; aspf=s"), ("x", None)], "name string, txt string")
    got = {r.msg_id: (r.spf, r.dkim, r.dmarc) for r in authcheck.own_auth(mail, records).collect()}
    assert got["ok"] == ("pass", "none", "pass") and got["bad"] == ("fail", "none", "fail") and got["open"] == ("none", "none", "none")
    assert got["inc"] == ("pass", "none", "pass") and got["soft"][0] == "softfail" and got["noip"] == (None, "none", "fail") and got["far"] == ("pass", "none", "fail")


def test_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(L.urlhaus_listed(F.lit(b))) for b in ('{"query_status":"ok","urls":[{"a":1}]}', '{"query_status":"ok","urls":[]}', '{"query_status":"no_results"}', '{"query_status":"bad"}', "x")] == [True, False, False, None, None]
    assert [one(L.safebrowsing_listed(F.lit(b))) for b in ('{"matches":[{"a":1}]}', "{}", "x")] == [True, False, None]
    stats = '{"data":{"attributes":{"last_analysis_stats":{"malicious":%d,"suspicious":0}}}}'
    assert [one(L.virustotal_listed(F.lit(b), F.lit(s))) for b, s in ((stats % 2, 200), (stats % 0, 200), ("", 404), ("x", 500))] == [True, False, False, None]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.duration_seconds(F.lit(x))) for x in ("1h30m", "250ms", "7d", "", "0", "x", "1.5h", "-2m", "d")] == [5400.0, 0.25, 604800.0, 0.0, 0.0, None, 5400.0, -120.0, None]
    assert [one(T.language_tag(F.lit(x))) for x in ("en-US", "KK", "de", "ru_RU", "")] == ["en", "kz", "ru", "ru", "ru"]
    catalog = {"ru": {"hi": "привет"}, "en": {"hi": "hello", "bye": "bye"}}
    assert [one(T.message(catalog, F.lit(a), F.lit(k))) for a, k in (("en", "hi"), ("kz", "hi"), ("ru", "bye"), ("en", "none"))] == ["hello", "привет", "bye", "none"]
    assert one(H.unicode_host(F.lit("xn--80ak6aa92e.com"))) == "аррӏе.com" and one(H.unicode_host(F.lit("plain.example"))) == "plain.example"


def test_custom_brands_and_images(spark):
    made = spark.createDataFrame([("Kaspi", ["kaspi.kz"], [], ["kaspi"], "kz", ["#f14635"], 0x0F0F0F0F0F0F0F0F, "", 0)], B.SCHEMA)
    own = spark.createDataFrame([("Acme KZ", ["acme.kz"], [], ["acme"], "kz", ["#0000ff"], None, "org1", 0), ("Kaspi", ["other.kz"], [], ["k"], "kz", [], None, "org1", 0)], B.SCHEMA)
    d = B.with_custom(made, own)
    assert rows(d.select("org_id", "name")) == [("", "Kaspi"), ("org1", "Acme KZ"), ("org1", "Kaspi")] and rows(B.with_custom(d, own).select("org_id", "name")) == rows(d.select("org_id", "name"))
    assert B.brands_of(d, "org2").count() == 1 and B.brands_of(d, "org1").count() == 3
    hosts = spark.createDataFrame([("acme.kz",), ("acme-portal.com",)], "host string")
    assert {r.host: (r.name, r.official) for r in B.match_hosts(hosts, B.brands_of(d, "org1")).collect()} == {"acme.kz": ("Acme KZ", True), "acme-portal.com": ("Acme KZ", False)}
    img = lambda h, c: f"named_struct('mime','x','size',1L,'sha256','x','phash',{h},'colors',{c},'width',9,'height',9)"
    mail = model.as_mail(spark.sql(f"SELECT 'logo' AS msg_id, array({img('1085102592571150095L ^ 65535L & 255L', 'array()')}) AS images UNION ALL SELECT 'tint', array({img('CAST(NULL AS BIGINT)', "array('#0505fa')")}) UNION ALL SELECT 'none', array({img('0L', "array('#00ff00')")})"))
    got = {r.msg_id: r.brand for r in B.with_brand(mail, d).collect() if r.brand}
    assert got["logo"].name == "Kaspi" and got["logo"].method == "logo" and got["tint"].name == "Acme KZ" and got["tint"].method == "color" and "none" not in got
