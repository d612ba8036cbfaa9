"""Personal details in free text, found and replaced by placeholders of their kind.

What counts as a detail is told by what it discloses in the corpus. A term
discloses a person or a detail if seeing it says, by its co-occurrence with
places that hold one, that one is there; the measure is the information between
the two, in bits.

* Names: places that hold a person are quoted sender names, introductions and
  header fields of earlier messages, salutations. Two disclosing terms side by
  side, or an initial before one, are generalised to a placeholder.
* Numbers, e-mail and street addresses: nearly every one is unique, so the terms
  are their shape (kind of prefix and number of digits, or kind of street) and
  the word before them. Values in a known form are seeds; a word discloses a
  kind if it stands before seeds of it, a shape if it stands behind such words.
  A seed counts if its shape discloses, and a number of no known form if the
  word before it does. The forms only say how such a value is written.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from mailquern.session import checkpointed

from .authored import WROTE
from .lookalike import _odd, _styles, repair, shape

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
_STREET = r"(?:street|str\.|st\.|road|rd\.?|lane|close|avenue|ave\.?|drive|court|square|boulevard|way|terrace|place|crescent)"
_CAP = r"[^\W\d_a-zа-я][\w’'-]+"
#: Forms of details in English, Russian and Kazakh, in order of precedence.
FORMS = (
    ("email", re.compile(r"(?:mailto:)?[\w.+%-]+(?:@|[ ]?[(\[] ?at ?[)\]][ ]?)(?:[\w-]+\.)+[\w-]{2,}", re.I)),
    ("id_number", re.compile(r"(?<![\w.+-])(?:\d{3}-\d{3}-\d{3}-\d{3}|\d{6}[ -]?\d{6})(?![\w-])")),
    ("id_number", re.compile(r"(?:\bID card|\bidentity card|удостоверени\w+(?: личности)?|жеке куәлі\w+|куәлі\w+)[ :]*(?:№|No\.?|N)?[ ]*(\d{9})(?!\w)", re.I)),
    ("id_number", re.compile(r"(?:passport|паспорт\w*|төлқұжат\w*)[ :]*(?:№|No\.?)?[ ]*([A-ZА-Я]{1,2} ?\d{7,8})(?!\w)", re.I)),
    ("id_number", re.compile(r"(?<!\w)N ?\d{8}(?!\w)")),
    ("phone", re.compile(r"(?<![\w+./-])(?:\+7|8)[ .-]?\(?7\d\d\)?[ .-]?\d{3}[ .-]?\d\d[ .-]?\d\d(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+./-])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,8}){1,4}(?![\w-])")),
    ("street_address", re.compile(rf"(?<!\w)\d{{1,4}}[a-z]? (?:{_CAP} ){{1,3}}(?i:{_STREET})(?!\w)(?:, (?i:apt\.?|flat|suite|unit) ?\d+)?")),
    ("street_address", re.compile(rf"(?:{_CAP} ){{1,3}}(?i:{_STREET}),? \d{{1,4}}[a-z]?(?!\w)(?:, (?i:apt\.?|flat|suite|unit) ?\d+)?")),
    ("street_address", re.compile(r"(?<!\w)(?:ул\.|улица|пр-т|просп\.|проспект|пр\.|пер\.|переулок|мкр\.?|микрорайон|б-р|бульвар|наб\.|набережная|шоссе|пл\.|площадь) ?[^,.;\n]{2,40}, ?(?:дом |д\. ?)?\d+\w?(?:-\d+)?(?:, ?(?:корпус|корп\.|кв\.|квартира|к\.) ?\d+)*", re.I)),
    ("street_address", re.compile(r"(?:[\w-]+ ){1,3}(?:көшесі|даңғылы|шағын ауданы|ықшамауданы|тұйығы|бульвары|тас жолы),? ?\d+\w?(?:-(?:үй|\d+)| үй)?(?:, ?\d+[ -]?пәтер)?", re.I)),
)


_STREETS = re.compile(rf"(?<!\w)(?:{_STREET}|ул\.|улица|пр-т|просп\.|проспект|пр\.|пер\.|переулок|мкр|микрорайон|б-р|бульвар|наб\.|набережная|шоссе|пл\.|площадь|көшесі|даңғылы|шағын ауданы|ықшамауданы|тұйығы|бульвары|тас жолы)(?!\w)", re.I)
#: What a text must hold for these to be looked for.
_STREET_MARKS = (" street", " str.", " st.", " road", " rd", " lane", " close", " avenue", " ave", " drive", " court", " square", " boulevard", " way", " terrace", " place", " crescent", "ул.", "улица", "пр-т", "просп", "пр.", "пер.", "переулок", "мкр", "микрор", "б-р", "бульв", "наб.", "набереж", "шоссе", "пл.", "площадь", "көшесі", "даңғылы", "аудан", "тұйығы", "тас жолы")
_AT_MARKS = ("@", "(at", "[at", "( at", "[ at")
_AT = re.compile(r"@|[ ]?[(\[] ?at ?[)\]][ ]?")
_LONG = re.compile(r"\d[\d ().-]{5,}\d")
#: A number of no known form: seven to fifteen digits in groups, no date, clock or IP address.
_NUMBER = re.compile(r"(?<![\w@./:+-])\(?\d[\d ().-]{5,}\d(?![\w@])")
_NO_NUMBER = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}|\d\d?\.\d\d?\.\d{4}.*|\d{4}-\d\d-\d\d.*")
_BEFORE = re.compile(r"([^\W\d_]+)[\W\d_]*\Z")


def valid_iin(digits: str) -> bool:
    """Whether twelve digits are an individual's number: a date of birth, a century's digit and the check digit."""
    d = [int(c) for c in digits]
    if len(d) != 12 or not 1 <= int(digits[2:4]) <= 12 or not 1 <= int(digits[4:6]) <= 31 or d[6] > 6:
        return False
    check = sum(w * x for w, x in zip(range(1, 12), d)) % 11
    if check == 10:
        check = sum(w * x for w, x in zip((3, 4, 5, 6, 7, 8, 9, 10, 11, 1, 2), d)) % 11
    return check == d[11]


def aligned(text: str) -> tuple[str, list[int] | None]:
    """A text without what shows nothing and in plain letters, and the place of each character in the original."""
    if text.isascii() or _odd().search(text) is None:
        return text, None
    out, at, styles = [], [], _styles()
    for i, c in enumerate(text):
        t = styles.get(ord(c), c)
        if t:
            out.append(t)
            at += [i] * len(t)
    return "".join(out), [*at, len(text)]


_TERM = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+(?:[’'-](?:[^\W\d_][̀-ͯ]*)+)*")
#: A term that begins with a capital.
_CAPITAL = regex.compile(r"(?<![\p{L}\p{M}]|[\p{L}\p{M}][’'-])\p{Lu}\p{M}*(?:\p{L}\p{M}*)*(?:[’'-](?:\p{L}\p{M}*)+)*")


@lru_cache(200_000)
def term_key(term: str) -> str:
    """The form in which terms are compared: scripts repaired, in lower case, letters of one shape alike."""
    return shape((repair(term) or term).lower())


def _shape(kind: str, value: str) -> str:
    """Kind, sort of prefix and number of digits, or kind of street or address: a few hundred shapes in all."""
    if kind == "email":
        return kind
    if kind == "street_address":
        m = _STREETS.search(value)
        return f"{kind} {m.group().lower() if m else ''}"
    head = next((c for c in value if c.isalnum() or c == "+"), "")
    return f"{kind} {'+' if head == '+' else '8' if head == '8' else 'a' if head.isalpha() else '9'} {min(sum(map(str.isdigit, value)), 20)}"


def _word_before(text: str, at: int) -> str:
    m = _BEFORE.search(text, max(0, at - 60), at)
    return term_key(m.group(1)) if m else "^"


def seeds_and_numbers(clean: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each value in a known form, and of each other number with the kind ``number``; of overlapping ones the first form stands."""
    found: list[tuple[str, int, int]] = []
    tried = set()
    numbers = [m for m in _LONG.finditer(clean) if sum(map(str.isdigit, m.group())) >= 7]
    if numbers:
        tried |= {"id_number", "phone"}
    low = clean.lower()
    if any(x in low for x in _STREET_MARKS) and _STREETS.search(clean) is not None:
        tried.add("street_address")
    if any(x in low for x in _AT_MARKS):
        for m in _AT.finditer(low):
            a = m.start()
            while a > 0 and (clean[a - 1].isalnum() or clean[a - 1] in "_.+%-"):
                a -= 1
            a -= 7 if low.startswith("mailto:", a - 7) else 0
            got = FORMS[0][1].match(clean, a)
            if got and not any(x < got.end() and a < y for _, x, y in found):
                found.append(("email", a, got.end()))
    for kind, form in FORMS:
        if kind not in tried:
            continue
        for m in form.finditer(clean):
            a, b = m.span(m.lastindex or 0)  # the value without the word that announces it
            if any(x < b and a < y for _, x, y in found):
                continue
            digits = re.sub(r"\D", "", m.group())
            if kind == "id_number" and form is FORMS[1][1] and not valid_iin(digits):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 14:
                continue
            found.append((kind, a, b))
    if numbers:
        for m in _NUMBER.finditer(clean):
            a, b = m.span()
            if 7 <= sum(map(str.isdigit, m.group())) <= 15 and not _NO_NUMBER.fullmatch(m.group()) and not any(x < b and a < y for _, x, y in found):
                found.append(("number", a, b))
    return found


def details(text: str, shapes: frozenset[str] | None = None) -> list[tuple[str, int, int, str | None, str | None]]:
    """(kind, start, end, term, term) of each detail, and of what may be one.

    Seeds of a disclosing shape (of any, if ``shapes`` isn't given) have no terms.
    Other numbers have the word before them as a term, pairs of capitalised
    terms and initials with one the terms of a possible name. Places are those
    of the original text.
    """
    clean, at = aligned(text)
    found, taken = [], []
    for kind, a, b in seeds_and_numbers(clean):
        if kind == "number":
            found.append((kind, a, b, None, "\x02" + _word_before(clean, a)))
        elif shapes is None or _shape(kind, clean[a:b]) in shapes:
            taken.append((a, b))
            found.append((kind, a, b, None, None))
    last = None
    for m in _CAPITAL.finditer(clean):
        t = m.group()
        if taken and any(x < m.end() and m.start() < y for x, y in taken):
            last = None
            continue
        if last is not None and m.start() - last.end() <= 2:
            gap = clean[last.end() : m.start()]
            one = last.group()
            if gap in (" ", ", ") and len(one) > 1 and len(t) > 1:
                found.append(("person_name", last.start(), m.end(), term_key(one), term_key(t)))
            elif gap in (". ", ".") and len(one) == 1 and len(t) > 1:
                found.append(("person_name", last.start(), m.end(), None, term_key(t)))
        last = m
    if at is not None:
        found = [(k, at[a], at[b - 1] + 1, x, y) for k, a, b, x, y in found]
    return found


#: Places that hold a person, in the plain text; each group is a term of the name.
_N = r"([^\W\d_]+(?:[’'-][^\W\d_]+)*)"
PLACES = tuple(
    re.compile(p, re.M)
    for p in (
        rf'^"{_N},? {_N}" ?<',
        rf"^{_N} {_N} \((?:mailto:)?\S+ ?[@(\[]",
        rf"(?:^|, ){_N} {_N}(?: ?<[^>\n]*>)? {WROTE}",
        rf"^[ \t]*\*?(?:From|От|Кімнен|Жіберуші):\*? {_N} {_N}(?: ?<|[ \t]*\r?$)",
        rf"^(?:Dear|Здравствуйте,|Уважаем\w+|Құрметті) {_N} {_N},",
    )
)


#: What a line must hold to hold such a place.
_MARKS = ('" <', '"<', " (", "wrote", "пишет", "написал", "жазды", "From:", "От:", "Кімнен:", "Жіберуші:", "Dear ", "Здравствуйте,", "Уважаем", "Құрметті ")


def _titled(t: str) -> bool:
    return len(t) > 1 and t[0].isupper() and t[1:].islower()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, shape, kind, held, seen) summed in each task: terms of names have no shape, all words together none of these."""
    held, seen, places, n_words = Counter(), Counter(), Counter(), 0
    for b in batches:
        raw: Counter = Counter()
        for t in b.column(0).to_pylist():
            clean, _ = aligned(t)
            n_words += clean.count(" ") + 1
            raw.update(_CAPITAL.findall(clean))
            if any(x in clean for x in _MARKS):
                for line in clean.split("\n"):
                    if any(x in line for x in _MARKS):
                        for p in PLACES:
                            if (m := p.search(line)) and all(map(_titled, m.groups())):
                                held.update(map(term_key, m.groups()))
            for kind, x, y in seeds_and_numbers(clean):
                places[_word_before(clean, x), _shape(kind, clean[x:y]), kind] += 1
        for t, n in raw.items():
            seen[term_key(t)] += n
    rows = [(t, None, "person_name", held[t], n) for t, n in seen.items()] + [(w, f, k, 0, n) for (w, f, k), n in places.items()] + [(None, None, None, 0, n_words)]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["word", "shape", "kind", "held", "seen"])


def disclosing_terms(texts: DataFrame, text: str, known: DataFrame | None = None, min_held: int = 2, min_bits: float = 2.0, min_share: float = 0.5) -> tuple[DataFrame, frozenset[str]]:
    """(term, kind, bits) of terms that disclose a person or the kind of the number behind them; and the disclosing shapes.

    ``bits`` is the log2 of a term's share of places that hold the kind over
    that of all words. Terms of names are counted with a capital in all texts
    and need ``min_held`` places and ``min_bits``; terms of ``known`` (a column
    ``term``) are the protected entities' own and always disclose. A word
    discloses the kind of a number behind it if at least ``min_share`` of the
    values behind it are seeds of the kind, too. A shape discloses by the words
    it stands behind. Counts cover all rows and are summed in each task first;
    the sums, a row a term, are written once. Only the shapes, a few hundred by
    their definition, come to the driver.
    """
    c = checkpointed(texts.where(F.col(text).isNotNull()).select(text).mapInArrow(_count, "word string, shape string, kind string, held long, seen long").groupBy("word", "shape", "kind").agg(F.sum("held").alias("held"), F.sum("seen").alias("seen")))
    names = c.where("kind = 'person_name'")
    overall = names.agg((F.sum("held") / F.sum("seen")).alias("overall"))
    learned = names.join(F.broadcast(overall)).select(F.col("word").alias("term"), "kind", F.log2(F.col("held") / F.col("seen") / F.col("overall")).alias("bits"), "held").where((F.col("held") >= min_held) & (F.col("bits") >= min_bits)).drop("held")
    values = c.where("shape IS NOT NULL")
    n_words = c.where("kind IS NULL").agg(F.sum("seen").cast("double").alias("n_words"))
    base = values.where("kind <> 'number'").groupBy("kind").agg(F.sum("seen").alias("n_kind")).join(F.broadcast(n_words)).select("kind", (F.col("n_kind") / F.col("n_words")).alias("base"))
    before = values.groupBy("word").agg(F.sum("seen").alias("n"))
    by_word = values.where("kind <> 'number'").groupBy("word", "kind").agg(F.sum("seen").alias("n_kind")).join(before, "word").join(F.broadcast(base), "kind")
    words = by_word.select("word", "kind", (F.col("n_kind") / F.col("n")).alias("share"), F.log2(F.col("n_kind") / F.col("n") / F.col("base")).alias("bits"), "n_kind")
    behind = values.where("kind <> 'number'").join(words.where(F.col("bits") >= min_bits).select("word", "kind", "share"), ["word", "kind"], "left")
    shapes = behind.groupBy("shape", "kind").agg((F.sum(F.col("seen") * F.coalesce("share", F.lit(0.0))) / F.sum("seen")).alias("held")).join(F.broadcast(base), "kind").where(F.log2(F.col("held") / F.col("base")) >= min_bits)
    numbers = words.where((F.col("bits") >= min_bits) & (F.col("share") >= min_share) & (F.col("n_kind") >= min_held) & F.col("kind").isin("phone", "id_number"))
    numbers = numbers.groupBy("word").agg(F.max_by(F.struct("kind", "bits"), "share").alias("k")).select(F.concat(F.lit("\x02"), "word").alias("term"), "k.kind", "k.bits")
    terms = learned.unionByName(numbers)
    if known is not None:
        own = known.select("term").where(F.length("term") > 1).distinct().select("term", F.lit("person_name").alias("kind"), F.lit(None).cast("double").alias("bits"))
        terms = terms.unionByName(own.join(learned, "term", "left_anti"))
    return terms, frozenset(r[0] for r in shapes.select("shape").collect())


def known_terms(staff: DataFrame, *columns: str) -> DataFrame:
    """The terms of the named columns, in the form terms are compared in; for tables of a fixed, small number of people."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [term_key(t) for c in b.columns for x in c.to_pylist() if x for t in _TERM.findall(aligned(x)[0])]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string())], ["term"])

    return staff.select(*columns).mapInArrow(run, "term string").distinct()


SPAN = "array<struct<kind:string,a:int,b:int,x:string,y:string>>"
_SPAN = {"kind": pa.string(), "a": pa.int32(), "b": pa.int32(), "x": pa.string(), "y": pa.string()}
#: A term that many texts hold is met by so many tasks.
SALTS = 16


def _spans(keys: list[str], shapes: frozenset[str] | None, placed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ends = [], [0]
            for t in b.column(b.num_columns - 1).to_pylist():
                d = details(t, shapes)
                rows += d if placed else dict.fromkeys((k, 0, 0, x, y) for k, _, _, x, y in d)
                ends.append(len(rows))
            columns = list(zip(*rows)) if rows else [()] * len(_SPAN)
            told = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _SPAN.values())], list(_SPAN))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *([b.column(b.num_columns - 1)] if placed else []), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)], [*keys, *(["text"] if placed else []), "spans"])

    return run


def located(df: DataFrame, keys: list[str], text: str, shapes: frozenset[str] | None = None, placed: bool = True) -> DataFrame:
    """(keys, text, spans): each non-null text with its details and what may be one; without places each kind and terms once, and no text."""
    src = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if placed or f.name != "text")
    return src.mapInArrow(_spans(keys, shapes, placed), f"{fields}, spans {SPAN}")


def confirmed(spans: DataFrame, terms: DataFrame, *keep: str) -> DataFrame:
    """(keep, s): the details, and what may be one and whose terms all disclose; a number gets the kind that its term discloses.

    Details need no join. The terms meet the rest by joins, so their number has
    no bound; each term stands for ``SALTS`` keys, so that a common one spreads.
    """
    one = spans.select(*keep, F.explode("spans").alias("s"))
    told = one.where(~F.col("s.kind").isin("person_name", "number"))
    salt = F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int")
    salted = terms.select("term", "kind", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    second = salted.select(F.col("term").alias("__y"), F.col("kind").alias("__kind"), F.col("salt").alias("__salt"))
    first = salted.where("kind = 'person_name'").select(F.col("term").alias("__x"), F.col("salt").alias("__salt"))
    maybe = one.where(F.col("s.kind").isin("person_name", "number")).withColumn("__salt", salt)
    met = maybe.withColumn("__y", F.col("s.y")).join(second, ["__y", "__salt"])
    whole = met.where(F.col("s.x").isNotNull()).withColumn("__x", F.col("s.x")).join(first, ["__x", "__salt"], "left_semi")
    kind = lambda d: d.select(*keep, F.col("s").withField("kind", F.col("__kind")).alias("s"))
    return told.unionByName(kind(met.where(F.col("s.x").isNull()))).unionByName(kind(whole))


def found_details(df: DataFrame, keys: list[str], text: str, terms: DataFrame, shapes: frozenset[str] | None = None) -> DataFrame:
    """Distinct (keys, pii_kind): the kinds of details in each text. Null and empty texts have none.

    The texts are read once: the kinds and terms in them are written and read again.
    """
    return confirmed(checkpointed(located(df, keys, text, shapes, placed=False)), terms, *keys).select(*keys, F.col("s.kind").alias("pii_kind")).distinct()


def _redact(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, todo in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                done, at = [], 0
                for s in sorted(todo or (), key=lambda s: (s["a"], s["b"], s["kind"])):
                    if s["a"] >= at:
                        done += [text[at : s["a"]], f"[{s['kind'].upper()}]"]
                        at = s["b"]
                out.append("".join([*done, text[at:]]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.string())], [*keys, "redacted"])

    return run


def redacted(df: DataFrame, keys: list[str], text: str, terms: DataFrame, shapes: frozenset[str] | None = None) -> DataFrame:
    """(keys, redacted): each non-null text with every detail replaced by ``[KIND]`` and all else untouched.

    Details that overlap are one, of the first one's kind. Repeated rows come
    out repeated. Texts are read once and written with a number of their own;
    only terms and places move to the joins, and a text moves again only if it
    holds what may be a name or number.
    """
    rows = checkpointed(located(df, keys, text, shapes).withColumn("__row", F.monotonically_increasing_id()))
    unsure = F.exists("spans", lambda s: s["kind"].isin("person_name", "number"))
    spans = confirmed(rows.where(unsure).select("__row", "spans"), terms, "__row").groupBy("__row").agg(F.collect_list(F.struct("s.a", "s.b", "s.kind")).alias("todo"))
    own = F.transform("spans", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind")))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keys)
    met = rows.where(unsure).select(*keys, "text", "__row").join(spans, "__row", "left").select(*keys, "text", "todo").unionByName(rows.where(~unsure).select(*keys, "text", own.alias("todo")))
    return met.mapInArrow(_redact(keys), f"{fields}redacted string")
