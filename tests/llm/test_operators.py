import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mailquern.llm import authored, bpe, garbled, leakage, lookalike, pieces, pii
from mailquern.llm.cooccur import pair_association
from mailquern.llm.frequent import MisraGries, clean_item, heavy_hitters


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 1


@pytest.mark.parametrize("a,b", [("сорреr.example", "copper.example"), ("ｎｏｒｔｈ", "north"), ("a‐b", "a-b"), ("no​rth", "north"), ("й", "й"), ("a b", "a b"), ("𝖻𝗈", "bo"), ("ё", "ë")])
def test_looks_the_same(a, b):
    assert lookalike.shape_key(a) == lookalike.shape_key(b)


@pytest.mark.parametrize("a,b", [("A", "a"), ("0", "o"), ("café", "cafe"), ("й", "и"), ("é", "è")])
def test_looks_different(a, b):
    assert lookalike.shape_key(a) != lookalike.shape_key(b)


def test_canonical(spark):
    d = spark.createDataFrame([(1, "the сopper leaf", "x"), (2, "copper copper", "y"), (3, None, "z"), (4, "", "z"), (1, "the сopper leaf", "x"), (5, "zzсzz", "q")], "id long, t string, canonical string")
    got = rows(lookalike.canonical(d, ["id"], "t").select("id", F.col("canonical")))
    assert got == [(1, "the copper leaf"), (1, "the copper leaf"), (2, "copper copper"), (4, ""), (5, "zzсzz")]
    assert lookalike.canonical(d.limit(0), ["id"], "t").count() == 0
    assert lookalike.repair("экcпреcс") == "экспресс" and lookalike.repair("abc") is None


@pytest.mark.parametrize(
    "raw,repaired",
    [
        ("please make Тһе соpу today", "please make The copy today"),  # tokens without a certain letter go by their line
        ("код из CMC для карты", "код из СМС для карты"),
        ("алтын-сарай.ɡον.test", "алтын-сарай.gov.test"),
        ("case PLAAC835Н.", "case PLAAC835H."),
        ("prо\u0301ximo", "próximo"),
        ("он сказал о том, a не о сем", "он сказал о том, а не о сем"),
        ("naïve café", "naïve café"),
    ],
)
def test_repairs_by_token_and_line(raw, repaired):
    p = lookalike.plain(raw)
    assert lookalike.put(p, lookalike.Repairs().places(p)) == repaired


def test_canonical_needs_the_vocabulary(spark):
    d = spark.createDataFrame([(1, "zzсzzb"), (2, "tоken"), (3, "tokеn"), (4, "сopper"), (5, "copper"), (6, "x" * 5000 + " сopper")], "id long, t string")
    got = dict(rows(lookalike.canonical(d, ["id"], "t").select("id", F.col("canonical"))))
    assert got[1] == "zzсzzb"  # no word of the corpus
    assert got[2] == got[3] == "token"  # two spellings of one word
    assert got[4] == "copper" and got[6].endswith(" copper")


def test_p1_found_pairs_distinct_texts(spark, tmp_path):
    from mailquern.llm.queries import p1_found

    spark.createDataFrame([(1, "apexdocs.test", "x"), (2, None, "x")], "domain_id long, domain_name string, extra string").write.parquet(f"{tmp_path}/known_domains.parquet")
    spark.createDataFrame([(7, " apexdocs.test"), (8, "аpexdocs.test"), (9, "apexdocs.test"), (10, None), (11, "Apexdocs.test")], "addr_id long, addr_domain string").write.parquet(f"{tmp_path}/addresses.parquet")
    spark.createDataFrame([(1, ["apexdocs\u200b.test", None, "apexdocs.test"]), (2, None)], "event_no long, link_domains array<string>").write.parquet(f"{tmp_path}/notify_events.parquet")
    bodies = [(i, "the copper leaf") for i in range(20)] + [(20, "the сopper leaf"), (20, "the сopper leaf"), (21, None), (22, ""), (23, "The copper leaf")]
    spark.createDataFrame(bodies, "prompt_id long, body string").write.parquet(f"{tmp_path}/prompt_data.parquet")
    got = rows(p1_found(spark, str(tmp_path)))
    assert got == [("addr_domain", 1, 7), ("addr_domain", 1, 8), *(("body", i, 20) for i in range(20)), ("link_domains", 1, 1)]


# 2


def test_pairs_against_brute_force(spark):
    rnd = random.Random(1)
    data = [(i % 90, [rnd.choice(["a", "b", "c", "d", None, "e"]) for _ in range(rnd.randint(0, 6))]) for i in range(90)] + [(90, None), (91, [])]
    data += data[:5]
    got = {(r.item_a, r.item_b): r for r in pair_association(spark.createDataFrame(data, "k long, s array<string>"), "s", key="k", min_count=3, min_share=0.01, min_lift=0.0).collect()}
    sets = [s for s in ({x for x in v if x} for v in dict(data).values() if v) if s]
    one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    want = {p: n for p, n in two.items() if n >= max(3, 0.01 * len(sets))}
    assert {p: r.n_both for p, r in got.items()} == want
    assert all(abs(r.lift - r.n_both * len(sets) / one[r.item_a] / one[r.item_b]) < 1e-9 for r in got.values())


def test_pairs_of_nothing(spark):
    assert pair_association(spark.createDataFrame([], "k long, s array<string>"), "s", key="k").count() == 0
    hot = spark.createDataFrame([(None, ["x", "y"])] * 12, "k long, s array<string>")
    assert rows(pair_association(hot, "s", key="k", min_lift=0.5).select("item_a", "item_b", "n_both")) == [("x", "y", 12)]


# 3


@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=6), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_misra_gries_keeps_frequent_items(parts, k):
    total, truth = MisraGries(k), Counter()
    for p in parts:
        s, c = MisraGries(k), Counter(p)
        truth += c
        s.add(list(c), list(c.values()))
        total.add(list(s.counts), list(s.counts.values()))
    n = sum(truth.values())
    assert len(total.counts) <= k
    assert all(truth[x] - n / (k + 1) <= total.counts.get(x, 0) <= truth[x] for x in truth)


def test_heavy_hitters(spark):
    data = [("f", "hot")] * 300 + [("f", f"v{i}") for i in range(3000)] + [("g", "one")] * 9 + [("g", None)] * 50
    got = rows(heavy_hitters(spark.createDataFrame(data, "field string, item string").repartition(7)).select("field", "item", "n"))
    assert got == [("f", "hot", 300), ("g", "one", 9)]
    assert heavy_hitters(spark.createDataFrame([], "field string, item string")).count() == 0
    c = spark.createDataFrame([("  A.b  ",), (" ",), (None,)], "x string").select(clean_item(F.col("x")))
    assert [r[0] for r in c.collect()] == ["a.b", None, None]


# 5

BODY = "Hello,\r\n\r\nPlease look at this.\r\n\r\n-- \r\nAnna Berg\r\nTel. +7 700 111 22 33\r\n\r\n"
NOTICE = "This e-mail and any files sent with it are confidential and meant only for the addressee. If it reached you by mistake, delete it and tell the sender."


@pytest.mark.parametrize("text,kinds", [
    (BODY, {"signature"}), ("Text.\n\nOn Mon, 1 Jan 2024 at 9:00,\nAnna Berg\n<a@b.example> wrote:\n\n> old\n> older", {"quoted"}), ("Text\n\n-----Original Message-----\nFrom: A\n\nold\n\nBest regards,\nAnna Berg", {"quoted"}),
    ("The amount is > 18 percent -- as planned.", set()), ("The auditor wrote that the desk is fine.", set()), ("Dear Anna Berg,\nfine.", set()), ("С уважением, Анна Берг, Тел. +7 700 111 22 33", {"signature"}), ("Да.\n\nОтправлено с моего телефона", {"signature"}),
    ("________________________________\nFrom: A\nSent: B\nSubject: C\n\nold", {"quoted"}), ("", set()),
])
def test_split_body(text, kinds):
    cut = authored.split_body(text)
    assert {k for k in ("quoted", "signature") if any(x.strip() for x in cut[k])} == kinds


def test_standing_notices(spark):
    d = [(i, f"Text {i}.\n\n{NOTICE}", None) for i in range(5)] + [(9, "New.\n\n" + NOTICE.replace("mistake", "mistakе").replace("tell", "told"), None), (10, "Please add the confidentiality notice to the template.", None), (11, None, None), (12, "", None), (13, "> " + NOTICE, None)]
    df = spark.createDataFrame(d, "id long, body string, new_text string")
    got = rows(authored.found_pieces(df, "id", "body"))
    assert got == [(i, "disclaimer") for i in range(5)] + [(9, "disclaimer"), (13, "quoted")]
    new = dict(rows(authored.classified(df, "id", "body").select("id", "new_text")))
    assert new[0] == "Text 0." and new[13] == "" and len(new) == 9
    assert authored.found_pieces(df.limit(0), "id", "body").count() == 0


def test_notices_of_any_length_and_place(spark):
    long = NOTICE + " " + "Opinions in it are those of its author, who may not speak for the company in any matter of contract, price or law. " * 4
    d = [(i, f"Text {i}.\n\n{long}") for i in range(5)] + [(7, f"First line\n{NOTICE}"), (8, f"We met at noon. {long} Bye now."), (9, "Long text of its own. " * 40)]
    df = spark.createDataFrame(d, "id long, body string")
    assert rows(authored.found_pieces(df, "id", "body")) == [(i, "disclaimer") for i in (*range(5), 7, 8)]
    new = dict(rows(authored.classified(df, "id", "body").select("id", "new_text")))
    assert [new[i] for i in (0, 7, 8)] == ["Text 0.", "First line", "We met at noon. Bye now."] and len(new[9]) > 800


WORDS = "amber birch cedar delta ember fjord grove heath islet juniper knoll larch".split()
OTHER = "If you have received this email in error, please notify us. It is intended solely for the person named."


def test_notices_by_place_and_recurrence(spark):
    signed = [(i, f"Hello,\n\nThe {w} report is ready for {w} now.\n\nBest regards,\nAnna Berg\n\n{OTHER}") for i, w in enumerate(WORDS[:4])]
    copies = [(10 + i, f"Dear {w},\n\nThe yearly sale of all our goods begins on Friday.\n\nBest regards,\nAnna Berg\n\nP.S. The first hundred guests get a gift.") for i, w in enumerate(WORDS[:5])]
    once = [(20, "One more thing.\n\nBest regards,\nAnna Berg\n\nThis letter may be privileged, so keep it.")]
    plain = [(30, f"The {WORDS[4]} report is ready.\n\nPlease call me.")]
    df = spark.createDataFrame([*signed, *copies, *once, *plain], "id long, body string")
    assert [r[0] for r in rows(authored.found_pieces(df, "id", "body")) if r[1] == "disclaimer"] == [0, 1, 2, 3, 20]
    assert dict(rows(authored.classified(df, "id", "body").select("id", "new_text")))[1] == "Hello,\n\nThe birch report is ready for birch now."
    unsigned = spark.createDataFrame([(i, f"The {w} report is ready for {w} now.\n\n{OTHER}") for i, w in enumerate(WORDS)] + [(20 + i, f"Hello,\n\nThe {w} fair opens.") for i, w in enumerate(WORDS)], "id long, body string")
    assert rows(authored.found_pieces(unsigned, "id", "body")) == [(i, "disclaimer") for i in range(len(WORDS))]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_banded_distance(a, b, k):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    assert authored.distance_within(a, b, k) == (d[-1] <= k)


# 6


def test_garbled(spark):
    russian = ["Сегодня отдел закупок сообщил что письмо отправлять никто не просил", "Аналитик написал что портал зарплаты работает без сбоев", "Просим выслать реквизиты до даты конец недели"]
    clean = [*russian, "Größere Anhänge bitte löschen", "Prüfung für Größe läuft", "Ђурђево: љето и кућа"] * 12
    bad = [t.encode(w).decode(r, "replace") for w, r in (("utf-8", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "latin-1")) for t in russian]
    bad += [clean[3].encode().decode("latin-1"), "Gr\ufffd\ufffdere", "Просим " + "выслать реквизиты".encode().decode("latin-1")]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, *bad, *bad, None, "", "plain"])], "id long, t string").withColumn("restored", F.lit("clash"))
    n, m = len(clean), len(bad)
    got = {r.id: r for r in garbled.find_garbled(d, ["id"], "t").collect()}
    assert set(got) == set(range(n, n + 2 * m))
    assert [got[n + i].restored for i in range(9)] == russian * 3
    assert got[n + 9].restored == clean[3] and got[n + 11].restored == "Просим выслать реквизиты"
    assert garbled.find_garbled(d.limit(0), ["id"], "t").count() == 0


GERMAN = [
    "Die Prüfung für Bördenau läuft noch, bitte große Anhänge löschen", "Für die Rückgabe müssen Sie das Formular ausfüllen", "Über die Änderung können wir später in der Küche sprechen", "Grüße aus Köln schickt Ihnen die Bürgermeisterin",
    "Die Bäume blühen schön, die Vögel hören wir täglich", "Möchten Sie die Rechnung überprüfen oder später zurückrufen", "Höhere Gebühren gelten für größere Pakete", "Der Schlüssel hängt hinter der Tür im Büro",
    "Wir würden gerne früher ankommen, wenn es möglich wäre", "Das Mädchen trägt schöne Kleider und süße Äpfel", "Ungewöhnliche Geräusche stören die Gäste im Gebäude", "Zurückgeschickte Päckchen müssen geöffnet werden",
]


def test_readings_are_learned_from_twins(spark):
    wrong = [x.encode().decode("cp1250", "replace") for x in GERMAN]
    d = spark.createDataFrame([*enumerate(GERMAN * 3), *((100 + i, x) for i, x in enumerate(wrong))], "id long, t string")
    got = {r.id: r.restored for r in garbled.find_garbled(d, ["id"], "t").collect()}
    assert set(got) == {100 + i for i in range(12)}
    assert sum(got[100 + i] == x for i, x in enumerate(GERMAN)) >= 10


def test_a_reading_that_no_encoding_explains(spark):
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    made = str.maketrans(letters, "".join(chr(0x2800 + (i * 7) % 32) for i in range(32)))
    words = "сумма письма не совпадает с тем что показывает сервис печати отправитель просит прислать код банка до конца недели ответит руководитель филиала города".split()
    rng = random.Random(3)
    clean = [" ".join(rng.choices(words, k=9)) + f" {i}" for i in range(900)]
    d = spark.createDataFrame([*enumerate(clean), *((1000 + i, x.translate(made)) for i, x in enumerate(clean[:6])), (1201, None), (1202, "")], "id long, t string")
    got = {r.id: r for r in garbled.find_garbled(d, ["id"], "t").collect()}
    assert set(got) == set(range(1000, 1006))
    assert [got[1000 + i].restored for i in range(6)] == clean[:6] and got[1000].undone[0].startswith("learned")


@pytest.mark.parametrize("block", [garbled.BLOCK, 3])
def test_every_garbled_sentence_of_a_key_is_aligned(spark, monkeypatch, block):
    monkeypatch.setattr(garbled, "BLOCK", block)
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    made = [str.maketrans(letters, "".join(chr(0x2800 + 32 * k + (i * 7) % 32) for i in range(32))) for k in range(20)]
    words = "сумма письма не совпадает с тем что показывает сервис печати отправитель просит прислать код банка до конца недели ответит руководитель филиала города".split()
    rng = random.Random(5)
    clean = [" ".join(rng.choices(words, k=9)) + f" {i}" for i in range(900)]
    d = spark.createDataFrame([*enumerate(clean), *((1000 + 20 * i + k, x.translate(m)) for i, x in enumerate(clean[:6]) for k, m in enumerate(made))], "id long, t string")
    got = {r.id: r.restored for r in garbled.find_garbled(d, ["id"], "t").collect()}
    assert got == {1000 + 20 * i + k: x for i, x in enumerate(clean[:6]) for k in range(20)}


def test_every_clean_sentence_of_a_key_is_a_partner(spark):
    rng = random.Random(7)
    told = [["".join(rng.sample(x, 4)) for _ in range(4)] for x in ("абвг", "дежз", "ийкл", "мноп", "рсту", "фхцч", "шщъы", "ьэюя")]
    often, seldom = ([" ".join(rng.choice(told[(j + i) % 8][i : i + 2]) for j in range(8)) + f" {n}" for n in range(300)] for i in (0, 2))
    assert [garbled.twin_keys(x)[0] for x in often] == [garbled.twin_keys(x)[0] for x in seldom]
    d = spark.createDataFrame([*enumerate([*often * 3, *seldom]), *((2000 + i, x.encode("koi8-r").decode("cp1251")) for i, x in enumerate(seldom[:6]))], "id long, t string")
    got = {r.id: r.restored for r in garbled.find_garbled(d, ["id"], "t").collect()}
    assert got == {2000 + i: x for i, x in enumerate(seldom[:6])}


@pytest.mark.parametrize("text", ["сумма письма", "naïve café", "x"])
def test_twin_keys(text):
    own, read = garbled.twin_keys(text)
    assert read == garbled.twin_keys("".join(c if c.isascii() else c.encode().decode("latin-1") for c in text))[0]


# 7


@pytest.mark.parametrize("text,kinds", [
    ("Write to a.b+c@x.example or mailto:a@b.example", ["email", "email"]), ("c [at] d.example", ["email"]), ("+7 (701) 735-11-97, 87054124435, +44 20 7946 0737", ["phone"] * 3), ("build 8.701.37, IP 192.0.2.23 at 09:23:00", []),
    ("IIN 970514452252 and 860-103-317-598", ["id_number"] * 2), ("Invoice 203799374417", []), ("passport N13159521; ID card 059949648", ["id_number"] * 2), ("Parcel code QX430047KL", []),
    ("at 42 Quarry Hill Road, now", ["street_address"]), ("Доставка: ул. Тобольная, дом 132, корпус 2.", ["street_address"]), ("Тобыл көшесі, 109 үй, 6 пәтер", ["street_address"]), ("rooms 15 to 99", []),
])
def test_forms(text, kinds):
    assert sorted(d[0] for d in pii.details(text) if d[0] not in ("person_name", "number")) == kinds


def test_names_and_redaction(spark):
    t = [(i, f'"Anna Bergström" <a{i}@x.example>') for i in range(4)] + [(5, "Please loop in Bergström, Anna today."), (6, "Altyn Security wrote to A. Bergström."), (7, None), (8, ""), (9, "Аnna Bergström here"), (10, "Altyn Security is fine. Altyn pays."), (10, "Altyn Security is fine. Altyn pays.")]
    d = spark.createDataFrame(t, "id long, t string").withColumn("text", F.lit("clash")).select("id", F.col("t").alias("body"), "text")
    terms, shapes = pii.disclosing_terms(d, "body", min_bits=0.1)
    got = rows(pii.found_details(d, ["id"], "body", terms, shapes))
    assert got == sorted([(i, k) for i in range(4) for k in ("email", "person_name")] + [(5, "person_name"), (6, "person_name"), (9, "person_name")])
    red = dict(rows(pii.redacted(d, ["id"], "body", terms, shapes)))
    assert red[0] == '"[PERSON_NAME]" <[EMAIL]>' and red[5] == "Please loop in [PERSON_NAME] today." and red[9] == "[PERSON_NAME] here" and red[8] == "" and 7 not in red
    assert pii.found_details(d.limit(0), ["id"], "body", terms, shapes).count() == 0
    none, no_shapes = pii.disclosing_terms(d.limit(0), "body")
    assert none.count() == 0 and not no_shapes and pii.found_details(d, ["id"], "body", none, no_shapes).count() == 0  # nothing comes out by form alone


@pytest.mark.parametrize("a,b", [("ЗАРИНА", "Зарина"), ("ТАМАРА", "Тамара"), ("HОNORA", "Honora"), ("Sаule", "SAULE")])
def test_term_keys(a, b):
    assert pii.term_key(a) == pii.term_key(b)


def test_numbers_by_what_stands_before_them(spark):
    filler = "The amount of this month is shown in the report of the desk and all of it is as planned for now "
    told = [filler + f"Call +7 701 123 45 {k}." for k in range(10, 14)] + [filler + f"The passport N1315952{k} is here." for k in range(4)] + [filler + f"Invoice 20379937441{k} is paid" for k in range(4)]
    probes = ["Call 555-867-5309 today", "Call (212) 555-0182 today", "passport 123456789", "passport 123-45-6789", "Invoice 5558675309", "Call 192.168.100.200 or 12.04.2024 10", "Total 555-867-5309"]
    d = spark.createDataFrame([*enumerate(told), *((100 + i, t) for i, t in enumerate(probes))], "id long, body string")
    terms, shapes = pii.disclosing_terms(d, "body")
    got = [r for r in rows(pii.found_details(d, ["id"], "body", terms, shapes)) if r[0] >= 100]
    assert got == [(100, "phone"), (101, "phone"), (102, "id_number"), (103, "id_number")]
    red = dict(rows(pii.redacted(d, ["id"], "body", terms, shapes)))
    assert red[100] == "Call [PHONE] today" and red[102] == "passport [ID_NUMBER]" and red[104] == "Invoice 5558675309"


# 8

ENC = bpe.encoder(bpe.vocabulary())
BITS = ["a", "b ", " ", "  ", "\n", "\n ", " \n", "\t", "'s", "é", "привет ", "123 ", "<|endoftext|>", " ", "\x1c", "\x85", "𝒳", " .", "!!", "_", "​", "²", "́", "日本", "　", "\r\n"]


@given(st.lists(st.sampled_from(BITS), max_size=20).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_public_library(text):
    import base64

    import tiktoken

    global _OWN
    if "_OWN" not in globals():
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(bpe.vocabulary(), "rb"))}
        _OWN = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ENC.ids(text) == _OWN.encode_ordinary(text)


def test_encode_texts(spark):
    d = spark.createDataFrame([(1, "Hello  world"), (2, ""), (3, None), (None, "x" * 20_000), (1, "Hello  world")], "k long, ids string").select("k", F.col("ids").alias("t"), F.lit(1).alias("ids"))
    got = [(r.k, len(r.ids)) for r in bpe.encode_texts(d, "k", "t").collect()]
    assert sorted(got, key=str) == sorted([(1, 3), (2, 0), (3, 0), (None, len(ENC.ids("x" * 20_000))), (1, 3)], key=str)
    assert bpe.encode_texts(d.limit(0), "k", "t").count() == 0


# 9


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=30))) for i in range(12)] + [(99, "too short"), (98, None)]
    docs = []
    for d in range(60):
        i, a, n = rnd.randrange(12), rnd.randrange(15), rnd.randint(8, 15)
        part = items[i][1].split()[a : a + n]
        docs.append((d, " ".join(rnd.choices(["x", "y", *vocab], k=20)) + " > " + ", ".join(p.upper() if d % 2 else p + "​" for p in part) + "\r\nend"))
    docs += [(100, None), (101, ""), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("run", F.lit("clash"))
    got = rows(leakage.leaked_items(df, "doc_id", "text", spark.createDataFrame(items, "item_id long, passage string"), "item_id", "passage", block_words=100))
    grams = lambda t: {tuple(w[k : k + 12]) for w in [leakage.words(t)] for k in range(len(w) - 11)}
    want = sorted({(d, i) for d, t in docs if t for i, p in items if p and grams(t) & grams(p)})
    assert got == want and len(want) > 20
    assert leakage.leaked_items(df, "doc_id", "text", spark.createDataFrame([], "item_id long, passage string"), "item_id", "passage").count() == 0


# 10


@pytest.mark.parametrize("text", ["word " * 3000, "x" * 9000, "аб" * 4000, "日本語" * 2000, "One. Two!\n" * 900, "# A\n\npara one.\n\npara two.\n\n" * 300, " " * 5000, "👩‍👩‍👧" * 900, "a\r\n\r\nb " * 1500])
@pytest.mark.parametrize("limit,overlap", [(1024, 64), (60, 8), (200, 0)])
def test_pieces(text, limit, overlap):
    got = pieces.split_text(ENC, text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(n == len(ENC.ids(text[a:b])) <= limit for a, b, n in got)
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert a <= c <= b < d
        if overlap == 0:
            assert c == b


def test_pieces_end_where_text_does():
    text = ("Alpha beta gamma. " * 20 + "\n\n") * 30
    assert all(text[b - 1] == "\n" for _, b, _ in pieces.split_text(ENC, text)[:-1])


def test_split_texts(spark):
    d = spark.createDataFrame([(1, "short"), (2, None), (3, ""), (4, "word " * 2500), (4, "word " * 2500)], "k long, piece string").select("k", F.col("piece").alias("t"), F.lit(0).alias("piece"))
    got = rows(pieces.split_texts(d, "k", "t").groupBy("k").agg(F.count("*").alias("n"), F.max("n_tokens").alias("m")))
    assert got[0] == (1, 1, 1) and [g[0] for g in got] == [1, 4] and got[1][1] >= 6 and got[1][2] <= 1024
    assert pieces.split_texts(d.limit(0), "k", "t").count() == 0
    assert np.dtype(np.int32).itemsize == 4


def test_a_part_that_fits_is_never_cut():
    enc = bpe.encoder(bpe.vocabulary())
    paragraph = " ".join("word alpha beta gamma delta." for _ in range(120))
    assert 700 < len(enc.encode(paragraph)) // 4 < 740
    text = "\n\n".join([paragraph] * 4)
    ends = [len(paragraph) * k + 2 * min(k, 3) for k in range(1, 5)]
    assert [b for _, b, _ in pieces.split_text(enc, text)] == ends
