"""Which brand a host or a text shows, and whether the host is the brand's own."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailquern import refdata
from mailquern.functions.hosts import registrable_domain
from mailquern.functions.text import normalise_homoglyphs

SCHEMA = "name string, domains array<string>, esp_domains array<string>, keywords array<string>, locale string, colors array<string>, logo_phash bigint, org_id string, load_order int"
#: More labels or keywords than this are matched in blocks, so that what a task holds stays bounded.
BLOCK = 5_000


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """Brands of a YAML or JSON file with a list ``brands``; names and lists in lower case but for the display name."""
    import json

    raw = open(path, encoding="utf-8").read()
    if path.endswith(".json"):
        rows = json.loads(raw)["brands"]
    else:
        import yaml

        rows = yaml.safe_load(raw)["brands"]
    low = lambda xs: [x.strip().lower() for x in xs or []]
    hash_of = lambda h: int(h, 16) - (1 << 64 if int(h, 16) >> 63 else 0) if h else None
    return spark.createDataFrame([(r["name"], low(r.get("domains")), low(r.get("esp_domains")), low(r.get("keywords")), r.get("locale", "global"), r.get("colors") or [], hash_of(r.get("logo_phash")), r.get("org_id", ""), i) for i, r in enumerate(rows)], SCHEMA)


def with_custom(brands: DataFrame, custom: DataFrame) -> DataFrame:
    """Brands with an organisation's own added; one of the same organisation and name takes the other's place, and comes after all loaded ones."""
    last = brands.agg(F.coalesce(F.max("load_order"), F.lit(-1)).alias("__last"))
    new = custom.withColumn("__n", F.row_number().over(Window.partitionBy("org_id").orderBy("name"))).join(F.broadcast(last)).withColumn("load_order", F.col("__last") + F.col("__n")).select(*brands.columns)
    return brands.join(new.select("org_id", "name"), ["org_id", "name"], "left_anti").select(*brands.columns).unionByName(new)


def brands_of(brands: DataFrame, org_id: str = "") -> DataFrame:
    """The brands that hold for an organisation: those of all and its own."""
    return brands.where((F.coalesce("org_id", F.lit("")) == "") | (F.col("org_id") == org_id))


def osa_distance(a: str, b: str) -> int:
    """Edits, each of one character, or a swap of two neighbours that are not edited again."""
    before, last, row = None, None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
    return row[-1]


def osa(a: Column, b: Column) -> Column:
    """The distance of two columns of short strings."""
    from pyspark.sql.types import IntegerType

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa_distance(p, q) for p, q in zip(x, y)], dtype="Int32")

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, IntegerType())(a, b)


def brand_labels(brands: DataFrame) -> DataFrame:
    """(name, label, load_order): a brand's distinctive tokens, words of its name and first labels of its domains."""
    words = F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != "")
    own = F.transform("domains", lambda d: F.get(F.filter(F.split(registrable_domain(d), "[._-]"), lambda x: x != ""), F.lit(0)))
    every = F.array_distinct(F.filter(F.concat(words, own), lambda w: w.isNotNull() & (F.char_length(w) >= 4) & ~w.isin(refdata.STOP_LABELS)))
    return brands.select("name", "load_order", "locale", F.explode(every).alias("label"))


def _shortened(word: str, most: int) -> set[str]:
    """A word and what is left of it after taking out up to ``most`` characters: words within that many edits share one."""
    out = now = {word}
    for _ in range(most):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out = out | now
    return out


def _nearest(labels: Sequence[tuple[str, str, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: dict[str, list[tuple[str, str, int]]] = {}
        for row in labels:
            if len(row[0]) >= 5:
                for w in _shortened(row[0], 2 if len(row[0]) >= 8 else 1):
                    index.setdefault(w, []).append(row)
        for pdf in batches:
            out = []
            for sld, hosts in pdf[pdf["sld"].str.len() >= 5].groupby("sld")["host"]:
                best = None
                for label, name, order in {row for w in _shortened(sld, 2) for row in index.get(w, ())}:
                    d = osa_distance(sld, label)
                    n = len(label)
                    if 0 < d <= (2 if n >= 8 else 1) and (best is None or (1 - d / n, -order) > (best[0], -best[2])):
                        best = (1 - d / n, name, order)
                if best:
                    out += [(host, best[1], best[0], best[2]) for host in hosts]
            yield pd.DataFrame(out, columns=["host", "name", "score", "load_order"])

    return run


def match_hosts(hosts: DataFrame, brands: DataFrame, host: str = "host") -> DataFrame:
    """(host, name, locale, official, method, score) of each distinct host that shows a brand.

    Official: the host is a brand's domain or lies below one, the first brand by
    load order. Else a look-alike: a label of the host is a brand's label
    (``typosquat``, or ``homoglyph`` where look-alike characters had to be
    folded; 0.95), or the registered label is near one in edits (``typosquat``,
    1 - distance / length). The best score wins, then the first brand.

    Hosts are made distinct first; exact matches are joins on suffixes and
    labels. Near ones meet through what both leave after a deletion or two, and
    only those are compared.
    """
    h = hosts.select(F.col(host).alias("host")).where(F.col("host") != "").distinct()
    parts = F.split("host", r"\.")
    suffixes = h.select("host", F.explode(F.transform(parts, lambda x, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))).alias("suffix"))
    own = brands.select("name", "locale", "load_order", F.explode(F.concat("domains", F.coalesce("esp_domains", F.array().cast("array<string>")))).alias("suffix"))
    official = suffixes.join(own, "suffix").groupBy("host").agg(F.min_by(F.struct("name", "locale"), "load_order").alias("b")).select("host", "b.name", "b.locale")
    labels = brand_labels(brands)
    folded = h.join(official, "host", "left_anti").select("host", F.explode(F.array_distinct(F.split(normalise_homoglyphs(F.col("host")), "[._-]"))).alias("label"), F.array_distinct(F.split(F.lower("host"), "[._-]")).alias("plain"))
    token = folded.join(labels, "label").select("host", "name", F.when(F.array_contains("plain", F.col("label")), "typosquat").otherwise("homoglyph").alias("method"), F.lit(0.95).alias("score"), "load_order")
    rest = h.join(official, "host", "left_anti").select("host", F.get(F.split(registrable_domain(normalise_homoglyphs(F.col("host"))), r"\."), F.lit(0)).alias("sld"))
    near = None
    block: list[tuple[str, str, int]] = []
    rows = labels.select("label", "name", "load_order").toLocalIterator()
    done = False
    while not done:
        block = [(r[0], r[1], r[2]) for _, r in zip(range(BLOCK), rows)]
        done = len(block) < BLOCK
        if block or near is None:
            part = rest.mapInPandas(_nearest(block), "host string, name string, score double, load_order int")
            near = part if near is None else near.unionByName(part)
    alike = token.unionByName(near.withColumn("method", F.lit("typosquat")))
    best = alike.groupBy("host").agg(F.max_by(F.struct("name", "method", "score"), F.struct("score", -F.col("load_order"))).alias("m"))
    unofficial = best.select("host", "m.name", "m.method", "m.score").join(brands.select("name", "locale").dropDuplicates(["name"]), "name", "left")
    return official.select("host", "name", "locale", F.lit(True).alias("official"), F.lit("domain").alias("method"), F.lit(1.0).alias("score")).unionByName(unofficial.select("host", "name", "locale", F.lit(False).alias("official"), "method", "score"))


def match_texts(texts: DataFrame, key: str, text: str, brands: DataFrame) -> DataFrame:
    """(key, name, locale, score): the brand whose keywords a text holds most of; two make a score of 1, ties go to the first."""
    words = brands.select("name", "locale", "load_order", F.explode("keywords").alias("word"))
    low, hit = texts.select(key, F.lower(text).alias("t")), None
    rows = words.toLocalIterator()
    done = False
    while not done:
        block = [tuple(r) for _, r in zip(range(BLOCK), rows)]
        done = len(block) < BLOCK
        if block or hit is None:
            part = low.join(F.broadcast(texts.sparkSession.createDataFrame(block, words.schema)), F.contains(F.col("t"), F.col("word")))
            hit = part if hit is None else hit.unionByName(part)
    counts = hit.groupBy(key, "name", "locale", "load_order").agg(F.least(F.lit(1.0), F.count("*") / 2.0).alias("score"))
    return counts.groupBy(key).agg(F.max_by(F.struct("name", "locale", "score"), F.struct("score", -F.col("load_order"))).alias("m")).select(key, "m.name", "m.locale", "m.score")


def color_score(a: Column, b: Column) -> Column:
    """1 - distance / 441 of two #rrggbb colours that are no more than 70 apart, else null."""
    part = lambda c, i: F.conv(F.substring(F.ltrim(c, F.lit("#")), i, 2), 16, 10).cast("double")
    d = F.sqrt(sum((F.pow(part(a, i) - part(b, i), 2) for i in (1, 3, 5)), F.lit(0.0)))
    return F.when(d <= 70, 1 - d / 441)


def logo_score(a: Column, b: Column) -> Column:
    """1 - differing bits / 64 of two image hashes that differ in no more than 8 bits, else null."""
    d = F.bit_count(a.bitwiseXOR(b))
    return F.when(d <= 8, 1 - d / 64.0)


def shown_brands(mail: DataFrame, brands: DataFrame) -> DataFrame:
    """(msg_id, brand, sender_brand, link_brands, own_domains) of the mails that show one.

    The brand is that of the sender's domain, else of the first link that
    imitates one, else of a logo, else of the keywords, where a colour of the
    brand in an image adds to the score. Distinct hosts are matched once; bodies
    are read for the keywords only.
    """
    every = F.concat(F.array("from.domain"), F.transform("links", lambda x: x["domain"]))
    hosts = mail.select("msg_id", F.posexplode(every).alias("at", "host")).where("host IS NOT NULL AND host <> ''").groupBy("msg_id", "host").agg(F.min("at").alias("at"), F.max("at").alias("last"))
    m = match_hosts(hosts, brands)
    hit = F.struct("name", "locale", "method", "score", "official")
    alike = F.when((F.col("last") > 0) & ~F.col("official"), F.struct(F.greatest("at", F.lit(1)).alias("at"), "host", "score", F.struct("name", "locale", F.concat(F.lit("link_"), "method").alias("method"), "score", "official").alias("hit")))
    met = hosts.join(m, "host").groupBy("msg_id").agg(F.max(F.when(F.col("at") == 0, hit)).alias("by_sender"), F.array_sort(F.collect_list(alike)).alias("alike"))
    words = match_texts(mail.select("msg_id", F.concat_ws("\n", "subject", "text_body").alias("t")), "msg_id", "t", brands)
    words = words.select("msg_id", F.struct("name", "locale", F.lit("keyword").alias("method"), "score", F.lit(False).alias("official")).alias("by_word"))
    own = brands.select(F.col("name").alias("__name"), F.concat("domains", F.coalesce("esp_domains", F.array().cast("array<string>"))).alias("own_domains")).dropDuplicates(["__name"])
    d = met.join(match_logos(mail, brands), "msg_id", "full").join(words, "msg_id", "full")
    d = d.select(
        "msg_id", F.coalesce("by_sender", F.get("alike", F.lit(0))["hit"], "by_logo", "by_word").alias("brand"), F.struct(F.col("by_sender.name").alias("name"), F.col("by_sender.official").alias("official"), F.col("by_sender.score").alias("score")).alias("sender_brand"),
        F.transform("alike", lambda x: F.struct(x["host"].alias("host"), x["score"].alias("score"))).alias("link_brands"),
    )
    return d.join(own, F.col("brand.name") == F.col("__name"), "left").drop("__name")


def match_logos(mail: DataFrame, brands: DataFrame) -> DataFrame:
    """(msg_id, by_logo): the brand whose logo an image is nearest, within eight bits; else whose colours one has, within the distance allowed.

    Eight differing bits leave one of nine parts of a hash alike, so distinct
    hashes meet by parts and no hash is compared with every brand.
    """
    images = mail.select("msg_id", F.explode("images").alias("i")).select("msg_id", F.col("i.phash").alias("phash"), F.col("i.colors").alias("colors"))
    cuts = [64 * k // 9 for k in range(10)]
    parts = lambda h: F.posexplode(F.array(*(F.expr(f"shiftrightunsigned({h}, {a}) & {(1 << (z - a)) - 1}") for a, z in zip(cuts, cuts[1:])))).alias("part", "bits")
    logos = brands.where("logo_phash IS NOT NULL").select("name", "locale", "load_order", "logo_phash", parts("logo_phash"))
    hashes = images.where("phash IS NOT NULL").select("phash").distinct().select("phash", parts("phash"))
    near = hashes.join(logos, ["part", "bits"]).withColumn("score", logo_score(F.col("phash"), F.col("logo_phash"))).where("score IS NOT NULL").groupBy("phash").agg(F.max(F.struct("score", (-F.col("load_order")).alias("o"), "name", "locale")).alias("b"))
    by_hash = images.join(near, "phash").select("msg_id", F.struct(F.lit(2).alias("rank"), F.col("b.score").alias("score"), F.col("b.o").alias("o"), F.col("b.name").alias("name"), F.col("b.locale").alias("locale"), F.lit("logo").alias("method")).alias("m"))
    own = brands.select("name", "locale", "load_order", F.explode("colors").alias("own"))
    tints = images.select(F.explode("colors").alias("color")).where("color IS NOT NULL").distinct()
    # colours within 70 of each other are in the same or neighbouring cubes of 70 a side
    cube = lambda c, i: F.floor(F.conv(F.substring(F.ltrim(F.col(c), F.lit("#")), i, 2), 16, 10).cast("int") / 70)
    around = lambda c, i: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: cube(c, i) + k))
    spread = own.withColumn("r", around("own", 1)).withColumn("g", around("own", 3)).withColumn("b", around("own", 5))
    like = tints.select("color", cube("color", 1).alias("r"), cube("color", 3).alias("g"), cube("color", 5).alias("b")).join(spread, ["r", "g", "b"]).withColumn("score", color_score(F.col("color"), F.col("own"))).where("score IS NOT NULL")
    best = like.groupBy("color").agg(F.max(F.struct("score", (-F.col("load_order")).alias("o"), "name", "locale")).alias("b"))
    by_color = images.select("msg_id", F.explode("colors").alias("color")).join(best, "color").select("msg_id", F.struct(F.lit(1).alias("rank"), F.col("b.score").alias("score"), F.col("b.o").alias("o"), F.col("b.name").alias("name"), F.col("b.locale").alias("locale"), F.lit("color").alias("method")).alias("m"))
    top = by_hash.unionByName(by_color).groupBy("msg_id").agg(F.max("m").alias("m"))
    return top.select("msg_id", F.struct("m.name", "m.locale", "m.method", "m.score", F.lit(False).alias("official")).alias("by_logo"))


def with_brand(mail: DataFrame, brands: DataFrame) -> DataFrame:
    """``mail`` with the columns of ``shown_brands``."""
    return mail.drop("brand").join(shown_brands(mail, brands), "msg_id", "left")
