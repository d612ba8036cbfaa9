"""E-mail bodies reduced to what their sender wrote anew.

The sentences of all bodies are fingerprinted by SimHash; near-matches in other
mails are retrieved through tables of the fingerprint's parts and verified by
edit distance. A sentence that has one is inherited or boilerplate - or new, in
a corpus whose writers repeat each other. So a match is needed, and the place
tells what it means: a block in the form of history (quote signs, header blocks,
introductions) is an earlier message if a sentence of it has a match, closing
lines are a signature if a part of them has one, and standing notices, which
have no form of their own, are told by where their sentences recur. Matched
sentences are taken out, whatever stands beside them.
"""

import re
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType

from mailquern.session import checkpointed

from .lookalike import plain, shape

#: Words that introduce an earlier message or name its header fields, in English, Russian and Kazakh.
WROTE = r"(?:wrote|пишет|написал(?:\(а\)|а)?|жазды)"
FIELDS = r"(?:From|Sent|Date|To|Cc|Subject|От|Отправлено|Дата|Кому|Копия|Тема|Кімнен|Жіберілді|Күні|Кімге|Тақырып|Жіберуші)"
FORWARDED = r"(?:Original Message|Forwarded message|Begin forwarded message|Исходное сообщение|Пересылаемое сообщение|Пересланное сообщение|Начало переадресованного сообщения|Бастапқы хабар|Түпнұсқа хабар|Қайта жіберілген хабар(?:дың басы)?)"
#: Closing phrases and device lines.
SIGN_OFF = r"(?:(?:kind|best|warm|many)(?:est)? regards|regards|best wishes|best|yours (?:sincerely|faithfully|truly)|sincerely(?: yours)?|thanks(?: and regards)?|cheers|с уважением|с наилучшими пожеланиями|всего доброго|всего хорошего|искренне ваш(?:а)?|ізгі тілекпен|ізгі ниетпен|құрметпен|сәлеммен)"
DEVICE = r"(?:sent from my [\w ]+|sent from (?:outlook|mail) for [\w ]+|get outlook for [\w ]+|отправлено с (?:моего )?[\w ]+|отправлено из [\w ]+|менің [\w ]+ жіберілді|[\w ]*телефонымнан жіберілді)"
#: Wording of standing notices. One such phrase lowers the evidence that a seed needs, and ends a signature; without any, place and recurrence tell.
NOTICE = (
    r"confidential(?:ity notice:| and meant| and intended)|named recipient|meant only for|intended only|if it reached you by mistake|may be privileged|use of it is unlawful|accepts no liability|before printing|do not bind the company|may be recorded",
    r"конфиденциальны и предназначены|уведомление о конфиденциальности:|указанному получателю|только адресату|если вы получили его по ошибке|третьим лицам без|запрещен[оаы]? законом|не несёт ответственности|не является офертой|мнение автора",
    r"құпия және тек|алушыға арналған|құпиялылық туралы ескерту:|таратуға тыйым|қателесіп алсаңыз|шығынға жауап бермейді",
)
_NOTICE = re.compile("|".join(NOTICE), re.I)
#: The plain beginnings of these wordings and of introductions: what a text without any can't hold.
_NOTICE_STARTS = tuple(re.match(r"[^\[(?]+", x).group() for y in NOTICE for x in y.split("|"))
_WROTE_STARTS = ("wrote", "пишет", "написал", "жазды")
_QUOTED = re.compile(r"^[ \t]*[>|](?:[ >|]|(?=\S)|$)")
_INTRO = re.compile(rf"(?:^|[\s>(:]){WROTE}(?: on [\d/. ]+)?[ \t]*(?:[:：]|-{{2,}})?[ \t]*-*$", re.I)
_FIELD = re.compile(rf"^[ \t]*\*?{FIELDS}[ \t]*:\*?", re.I)
_FORWARD = re.compile(rf"^[ \t]*[-_=*]*[ \t]*{FORWARDED}[ \t]*:?[ \t]*[-_=*]*[ \t]*$", re.I)
_RULE = re.compile(r"^[ \t]*[_=-]{10,}[ \t]*$")
_DASHES = re.compile(r"^[ \t]*(?:--|—|–|_{2,9}|-{3,9})[ \t]*$")
_OFF = re.compile(rf"^[ \t]*{SIGN_OFF}[ \t]*(?:[,.!—–-].*)?$", re.I)
_DEVICE = re.compile(rf"^[ \t]*{DEVICE}[ \t]*[.!]?[ \t]*$", re.I)
_UPPER = r"[A-ZÀ-ÞА-ЯЁӘІҢҒҮҰҚӨҺ]"
_ONE = rf"{_UPPER}[\w’'-]+"
_NAME = re.compile(rf"^[ \t]*[/~*—–-]?[ \t]*(?:{_ONE},? {_ONE}|{_UPPER}\. ?{_ONE})(?:[ \t]*[|,/].*)?[ \t]*$")
_CONTACT = re.compile(r"@|\+?\d[\d ().-]{8,}\d|\b(?:tel|phone|тел)\b", re.I)


def _worded(text: str) -> bool:
    """Whether a text has a notice's wording."""
    low = text.lower()
    return any(x in low for x in _NOTICE_STARTS) and bool(_NOTICE.search(text))


def split_body(text: str) -> dict[str, list[str]]:
    """The lines of a body as new, quoted and signature; the new ones keep blank lines between paragraphs.

    Pieces inside quoted history are history. Lines with a quote sign are
    quoted with the introduction before them; after a header block, a forwarding
    line or an introduction without quote signs all that follows is.
    """
    own, signed, earlier = _cut(text)
    out: dict[str, list[str]] = {"new": [], "quoted": earlier, "signature": []}
    for x, s in zip(own, signed):
        out["signature" if s else "new"].append(x)
    return out


def _cut(text: str) -> tuple[list[str], list[bool], list[str]]:
    """A body's own lines, which of them sign it, and its quoted lines."""
    lines = plain(text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    n, low = len(lines), [x.lower() for x in lines]
    quoted = [bool(_QUOTED.match(x)) for x in lines]
    for i, x in enumerate(lines):
        if quoted[i]:
            continue
        if any(w in low[i] for w in _WROTE_STARTS) and _INTRO.search(x):
            first = i  # an introduction may be folded over as many as three lines
            while first > 0 and i - first < 2 and lines[first - 1].strip() and not _opens(lines[first]) and not quoted[first - 1]:
                first -= 1
            after = next((k for k in range(i + 1, n) if lines[k].strip()), n)
            if after == n and first == i and not _opens(x) and "<" not in x and not x.rstrip().endswith(":"):
                continue
            end = i + 1 if after < n and quoted[after] else n
            quoted[first:end] = [True] * (end - first)
        elif _FORWARD.match(x) and x.strip():
            quoted[i:] = [True] * (n - i)
        elif _FIELD.match(x) and sum(bool(_FIELD.match(y)) for y in takewhile(str.strip, lines[i:])) >= 2:
            first = i - 1 if i and _RULE.match(lines[i - 1]) else i
            quoted[first:] = [True] * (n - first)
    own = [x for x, q in zip(lines, quoted) if not q]
    return own, _signature(own), [x for x, q in zip(lines, quoted) if q]


def _opens(line: str) -> bool:
    """Whether a line can begin an introduction: a date, a name with an address, a weekday or On."""
    return bool(re.match(r"^[ \t]*(?:-+ |On |\d{1,2}[./]\d{1,2}[./]|\d{4}-\d\d|(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)|" + _ONE + " " + _ONE + r" )", line))


def _signature(lines: list[str]) -> list[bool]:
    """Which lines sign the mail; a signature reaches to the end of its block, standing notices excepted."""
    n, out = len(lines), [False] * len(lines)
    for i, x in enumerate(lines):
        if out[i] or not x.strip():
            continue
        rest = [k for k in range(i + 1, n) if lines[k].strip()]
        follows = next((lines[k] for k in rest[:1]), "")
        starts = bool(_DEVICE.match(x))
        if _DASHES.match(x):
            starts = bool(_NAME.match(follows) or _OFF.match(follows) or _CONTACT.search(follows) or _DEVICE.match(follows))
        elif _OFF.match(x):
            same = re.sub(rf"^[ \t]*{SIGN_OFF}", "", x, flags=re.I)
            starts = bool(_NAME.match(follows) or _CONTACT.search(follows) or re.search(rf"{_ONE} {_ONE}|{_UPPER}\. ?{_ONE}", same) or _CONTACT.search(same))
        elif _NAME.match(x):
            bare = re.sub(r"[|/,].*", "", x)
            starts = not re.search(r"[.!?:]$", x.strip()) or bool(_CONTACT.search(x))
            starts = starts and (i > 0 or len(rest) == 0 or bool(_CONTACT.search(" ".join(lines[k] for k in rest[:3])))) and not x.strip().endswith(",") and len(bare.split()) <= 4
        if starts:
            k = i
            while k < n and (lines[k].strip() or k == i) and not (k > i and _worded(lines[k])):
                out[k] = True
                k += 1
    return out


_FOLD = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Text as sentences are compared: shapes of letters in lower case, words with single blanks."""
    return _FOLD.sub(" ", shape(plain(text)).lower()).strip()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit fingerprints of folded texts' character 4-grams, each gram as often as it occurs; a shorter text is one gram."""
    padded = [t.ljust(4, "\0") for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in padded])
    h = points.copy()
    for k in range(1, 4):
        h[:-k] += points[k:] * np.uint64(0x9E3779B97F4A7C15 >> 8 * k | 1)
    for m, r in ((_M1, 30), (_M2, 27)):
        h = (h ^ (h >> np.uint64(r))) * m
    h ^= h >> np.uint64(31)
    ends = np.cumsum(lengths)
    whole = np.ones(len(h), bool)
    for k in range(1, 4):
        whole[ends - k] = False  # grams that would reach into the next text
    n = lengths - 3
    bits = np.unpackbits(h[whole].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(n)[:-1])), axis=0, dtype=np.int32)
    return np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``; a band of the table is computed."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), far) <= most


#: Bits in which fingerprints of near-matches may differ, and the parts of the fingerprint: with one part more, one must agree.
NEAR_BITS, PARTS = 3, 4
NEAR_SHARE = 0.1


_END = re.compile(r"[.!?\u2026\u3002]+[\"'\u201d\u2019\u00bb)\]*]*\s+")


def sentences(lines: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """A paragraph on one line, and the places of its sentences.

    Whether a line break ends a sentence or folds it can't be told, so the
    sentences come both ways where the two differ.
    """
    parts = [y for x in lines if (y := " ".join(x.split()))]
    text = " ".join(parts)
    ends = [m.end() for m in _END.finditer(text)]
    breaks = [sum(map(len, parts[:k])) + k for k in range(1, len(parts))]
    spans: dict[tuple[int, int], None] = {}
    for cuts in (ends, sorted({*ends, *breaks})) if breaks else (ends,):
        edges = [0, *(c for c in cuts if c < len(text)), len(text)]
        spans.update(dict.fromkeys(zip(edges, edges[1:])))
    return text, list(spans)


def _paragraphs(own: list[str], signed: list[bool]) -> list[tuple[list[str], bool]]:
    """(lines, whether a signature stands before) of each paragraph; blank and signing lines part them."""
    out: list[tuple[list[str], bool]] = []
    now: list[str] = []
    after = False
    for x, s in zip([*own, ""], [*signed, False]):
        if s or not x.strip():
            if now:
                out.append((now, after))
                now = []
            after |= s and bool(x.strip())
        else:
            now.append(x)
    return out


#: What is told of a sentence: its paragraph and place there (of own text), the hashes of its folded text, of its letters as they stand and of the text it stands behind, and where it stands.
MARKS = {"no": "int", "start": "int", "end": "int", "id": "bigint", "exact": "bigint", "context": "bigint", "first": "boolean", "worded": "boolean", "own": "boolean", "after": "boolean", "last": "boolean", "part": "tinyint"}
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "tinyint": pa.int8()}
OWN, QUOTED, SIGNED = 0, 1, 2
_SIGNS = re.compile(r"^[ \t]*(?:[>|][ >|]*)+")
_PIECES = re.compile(r"[,|/]|[ \t][—–-]+[ \t]")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _quoted_sentences(lines: list[str]) -> Iterator[str]:
    """The sentences of quoted lines without their quote signs."""
    now: list[str] = []
    for x in [*lines, ""]:
        x = _SIGNS.sub("", x)
        if x.strip():
            now.append(x)
        elif now:
            text, spans = sentences(now)
            yield from (text[a:b] for a, b in spans)
            now = []


class _Teller:
    """What is told of each line or sentence; kept, up to a number of them."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, bool, int, int]] = {}
        self.said: set[int] = set()
        self.new: list[tuple[int, str]] = []

    def __call__(self, line: str) -> tuple[int, bool, int, int]:
        """(hash of the folded text or 0 without a word, whether it has a notice's wording, hash as it stands, length)."""
        got = self.memo.get(line)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            f = folded(line)
            got = self.memo[line] = (_hash(f) if f else 0, _worded(line), _hash(" ".join(shape(line).lower().split())), len(f))
            if f and got[0] not in self.said:
                if len(self.said) > 1_000_000:
                    self.said.clear()
                self.said.add(got[0])
                self.new.append((got[0], f))
        return got


def _blocks(key: str):
    names = list(MARKS)

    def marks(tell: _Teller, text: str) -> tuple[bool, bool, int, list[str], list[tuple]]:
        own, signs, earlier = _cut(text)
        cut = _paragraphs(own, signs)
        is_signed = any(s and x.strip() for x, s in zip(own, signs))
        paragraphs, rows = [], []
        firsts: dict[int, list] = {}
        longest = seen = 0
        for no, (lines, after) in enumerate(cut):
            text, spans = sentences(lines)
            paragraphs.append(text)
            last = no == len(cut) - 1
            apart = after or last
            beside = apart and (after or no > 0) and _worded(text)
            context, ends = longest, last and no > 0 and not is_signed
            for start, end in spans:
                f, worded, exact, size = tell(text[start:end])
                if f:
                    row = [no, start, end, f, exact, context, exact not in firsts, beside or apart and worded, worded, after, ends, OWN]
                    firsts.setdefault(exact, row)[7] |= row[7]
                    rows.append(row)
                    if not after and size > seen:
                        longest, seen = f, size
        quoted = dict.fromkeys(f for x in _quoted_sentences(earlier) if (f := tell(x)[0]))
        signed = dict.fromkeys(f for x, s in zip(own, signs) if s for y in _PIECES.split(x) if (f := tell(y)[0]))
        whole = 0
        for f in (*dict.fromkeys(r[3] for r in rows), *quoted):
            whole ^= f
        for part, ids in ((QUOTED, quoted), (SIGNED, signed)):
            rows += [[-1, 0, 0, f, 0, 0, False, False, False, False, False, part] for f in ids]
        return bool(earlier), is_signed, whole, paragraphs, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = _Teller()
        for b in batches:
            quoted, signed, wholes, news, rows, ends, texts, text_ends = [], [], [], [], [], [0], [], [0]
            for t in b.column(1).to_pylist():
                q, s, whole, paragraphs, own = marks(tell, t)
                quoted.append(q)
                signed.append(s)
                wholes.append(whole)
                news.append(paragraphs)
                rows += own
                ends.append(len(rows))
                texts += tell.new
                tell.new = []
                text_ends.append(len(texts))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            told = pa.StructArray.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, MARKS.values())], names)
            said = pa.StructArray.from_arrays([pa.array([x for x, _ in texts], pa.int64()), pa.array([y for _, y in texts], pa.string())], ["id", "folded"])
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for e, v in ((ends, told), (text_ends, said))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(quoted, pa.bool_()), pa.array(signed, pa.bool_()), pa.array(wholes, pa.int64()), pa.array(news, pa.list_(pa.string())), *lists], [key, "quoted", "signature", "whole", "paragraphs", "marks", "said"])

    return run


def body_blocks(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, quoted, signature, whole, paragraphs, marks, said): each non-null body cut by form, and what is told of its sentences.

    ``quoted`` and ``signature``: whether a block has that form. Sentences are
    named by the hash of their folded text; ``said`` holds the texts themselves,
    each where a task meets it first. ``whole`` is a hash of all sentences of a
    body, alike for copies of one mail.
    """
    src = df.where(F.col(body).isNotNull()).select(key, body)
    kinds = ",".join(f"{n}:{k}" for n, k in MARKS.items())
    return src.mapInArrow(_blocks(key), f"`{key}` {src.schema[0].dataType.simpleString()}, quoted boolean, signature boolean, whole bigint, paragraphs array<string>, marks array<struct<{kinds}>>, said array<struct<id:bigint,folded:string>>")


@F.pandas_udf(LongType())
def _simhash(a: pd.Series) -> pd.Series:
    texts = a.tolist()
    parts = [simhashes(texts[i : i + 1000]).view(np.int64) for i in range(0, len(texts), 1000)]
    return pd.Series(np.concatenate(parts) if parts else [], dtype="int64")


@F.pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance_within(x, y, int(NEAR_SHARE * max(len(x), len(y)))) for x, y in zip(a, b)])


def notice_seeds(blocks: DataFrame, key: str, min_mails: int = 3) -> DataFrame:
    """(id): sentences that belong to standing notices of law or company.

    A seed is told by what the whole corpus shows. One of these must hold:

    * After the signature, word for word and digit for digit, in mails of at
      least ``min_mails`` different texts, and in four of five of the signed
      mails that hold it. Copies of one mail, whatever their salutation, are one
      text.
    * The last paragraph of unsigned mails after at least ten different texts,
      and in nine of ten of all that hold it, where so few mails are signed that
      less than one of these could be expected to be.
    * A notice's wording in it or in its paragraph, and in at least
      ``min_mails`` mails and four of five of all at the end or after the
      signature.
    * A notice's wording in it, and after the signature in each signed mail that
      holds it, be it one.

    Distinct texts are compared, so a notice in a third of all mails is one row.
    """
    share = blocks.agg(F.coalesce(F.avg(F.col("signature").cast("double")), F.lit(0.0)).alias("share"))
    p = blocks.select("signature", F.explode("marks").alias("m")).where(f"m.first AND m.part = {OWN}").select("signature", "m.*")
    texts = p.groupBy("id", "exact", "context").agg(F.count("*").alias("mails"), F.count_if("signature").alias("signed"), F.count_if("after").alias("after"), F.count_if("last").alias("last"), F.count_if("worded").alias("worded"), F.bool_or("own").alias("own"))
    sums = [F.sum(c).alias(c) for c in ("mails", "signed", "after", "last", "worded")]
    exact = texts.groupBy("id", "exact").agg(*sums, F.bool_or("own").alias("own"), F.count_if(F.col("after") > 0).alias("after_texts"), F.count_if(F.col("last") > 0).alias("last_texts")).join(F.broadcast(share))
    behind = (F.col("after_texts") >= min_mails) & (F.col("after") >= 0.8 * F.col("signed"))
    ends = (F.col("last_texts") >= 10) & (F.col("last") >= 0.9 * F.col("mails")) & (F.col("mails") * F.col("share") < 1)
    rare = F.col("own") & (F.col("after") > 0) & (F.col("after") == F.col("signed"))
    told = exact.select("id", "mails", "worded", (behind | ends | rare).alias("told"))
    by_text = told.groupBy("id").agg(F.sum("mails").alias("mails"), F.sum("worded").alias("worded"), F.bool_or("told").alias("told"))
    return by_text.where(F.col("told") | (F.col("worded") >= min_mails) & (F.col("worded") >= 0.8 * F.col("mails"))).select("id")


def near_matches(some: DataFrame, every: DataFrame) -> DataFrame:
    """(id, other): for sentences of ``some`` (id, folded, hash) each other one of ``every`` that is near it.

    Fingerprints share one of four parts of sixteen bits and differ in at most
    three bits; the edit distance is at most a tenth of the length.
    """
    part = F.posexplode(F.array(*(F.expr(f"shiftrightunsigned(hash, {64 // PARTS * i}) & {(1 << 64 // PARTS) - 1}") for i in range(PARTS)))).alias("part", "bits")
    left = some.select("id", F.col("folded").alias("one"), "hash", part)
    right = every.select(F.col("id").alias("other"), F.col("folded").alias("two"), F.col("hash").alias("theirs"), part)
    close = left.join(right, ["part", "bits"]).where((F.col("id") != F.col("other")) & (F.bit_count(F.col("hash").bitwiseXOR(F.col("theirs"))) <= NEAR_BITS))
    pairs = close.groupBy("id", "other").agg(F.first("one").alias("one"), F.first("two").alias("two"))
    return pairs.where(_near("one", "two")).select("id", "other")


def resolved(blocks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, piece), (id)): inherited history and signatures, and the sentences of standing notices.

    A block in the form of history or of a signature counts if a sentence of it
    has a near-match in another mail. Equal sentences have equal fingerprints,
    so they are met by their hash; copies of one mail are one mail. What is left
    without a match, and the seeds of notices, are looked up in the tables: any
    sentence near a seed is a notice, too.
    """
    m = blocks.select(key, "whole", F.explode("marks").alias("m")).select(key, "whole", "m.id", "m.part")
    twice = m.groupBy("id").agg((F.min("whole") != F.max("whole")).alias("twice"))
    formed = m.where(F.col("part") != OWN).select(key, "id", "part").join(twice, "id")
    told = checkpointed(formed.groupBy(key, "part").agg(F.bool_or("twice").alias("met"), F.collect_set(F.when(~F.col("twice"), F.col("id"))).alias("ids")).select(key, "part", "met", F.when(~F.col("met"), F.col("ids")).alias("ids")))
    alone = told.where("NOT met").select(key, "part", F.explode("ids").alias("id"))
    seeds = checkpointed(notice_seeds(blocks, key))
    every = checkpointed(blocks.select(F.explode("said").alias("s")).groupBy("s.id").agg(F.min("s.folded").alias("folded")).repartition("id").withColumn("hash", _simhash("folded")))
    some = every.join(alone.select("id").unionByName(seeds).distinct(), "id", "left_semi")
    near = checkpointed(near_matches(some, every))
    piece = F.when(F.col("part") == QUOTED, "quoted").otherwise("signature").alias("piece")
    pieces = told.where("met").select(key, piece).unionByName(alone.join(near, "id", "left_semi").select(key, piece).distinct())
    return pieces, seeds.unionByName(near.join(seeds, "id", "left_semi").select(F.col("other").alias("id"))).distinct()


@F.pandas_udf(StringType())
def _without(paragraphs: pd.Series, spans: pd.Series) -> pd.Series:
    """Paragraphs without the (number, start, end) places; those with no word left are dropped."""
    out = []
    for ps, cut in zip(paragraphs, spans):
        gone: dict[int, list[tuple[int, int]]] = {}
        for no, start, end in cut if cut is not None else ():
            gone.setdefault(int(no), []).append((int(start), int(end)))
        left = []
        for no, p in enumerate(ps):
            if no in gone:
                at, keep = 0, []
                for start, end in sorted(gone[no]):
                    keep.append(p[at : max(at, start)])
                    at = max(at, end)
                p = " ".join("".join([*keep, p[at:]]).split())
                if not re.search(r"\w", p):
                    continue
            left.append(p)
        out.append("\n\n".join(left))
    return pd.Series(out, dtype=object)


def classified(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, quoted, signature, disclaimer, new_text): each non-null body's kinds of pieces, and what is left as newly written.

    What has the form of history or of a signature is left out of the new text
    whether or not a match is found.
    """
    src, named, key = df.select(F.col(key).alias("__key"), F.col(body).alias("body")), key, "__key"
    blocks = checkpointed(body_blocks(src, key, "body"))
    marked = blocks.drop("paragraphs")
    pieces, notices = resolved(marked, key)
    marks = blocks.select(key, F.explode("marks").alias("m")).where(f"m.part = {OWN}").select(key, F.array("m.no", "m.start", "m.end").alias("span"), "m.id")
    hits = marks.join(notices, "id", "left_semi").groupBy(key).agg(F.collect_set("span").alias("spans"))
    kinds = pieces.groupBy(key).agg(F.bool_or(F.col("piece") == "quoted").alias("q"), F.bool_or(F.col("piece") == "signature").alias("s"))
    met = blocks.select(key, "paragraphs").join(hits, key, "left").join(kinds, key, "left")
    return met.select(F.col(key).alias(named), F.coalesce("q", F.lit(False)).alias("quoted"), F.coalesce("s", F.lit(False)).alias("signature"), F.col("spans").isNotNull().alias("disclaimer"), _without("paragraphs", "spans").alias("new_text"))


def found_pieces(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, piece): one row for each kind of piece - quoted, signature, disclaimer - that a body holds.

    Null and empty bodies hold none. The bodies are read once: what is told of
    them, without their text, is written and read again.
    """
    src, named, key = df.select(F.col(key).alias("__key"), F.col(body).alias("body")), key, "__key"
    blocks = checkpointed(body_blocks(src, key, "body").drop("paragraphs"))
    pieces, notices = resolved(blocks, key)
    standing = blocks.select(key, F.explode("marks").alias("m")).where(f"m.part = {OWN}").select(key, "m.id").join(notices, "id", "left_semi").select(key, F.lit("disclaimer").alias("piece")).distinct()
    return pieces.unionByName(standing).withColumnRenamed(key, named)
