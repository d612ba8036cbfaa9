"""Text that was read in another encoding than it was written in: found, and restored where nothing was lost.

Garbled sentences are joined with clean ones on their text stripped of
non-ASCII characters. What a wrong reading keeps besides is which characters
are equal, so the pattern of equal characters (or, for a clean sentence written
in UTF-8, of equal bytes) is part of the key: twins agree in it, other
sentences don't. The twins' characters are aligned one by one, and what the
alignments agree on are the corpus's wrong readings: tables from characters to
characters, or to bytes of UTF-8. No encoding is presumed; where one that Python
knows agrees with a table, it completes it with the characters not yet seen.
The readings so learned are then applied to all records.

Whether a restored run of characters is language is told by the corpus, too: by
how often its neighbouring characters stand together in all texts.
"""

from __future__ import annotations

import encodings.aliases
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from operator import ne

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mailquern.session import checkpointed

_PART = re.compile(r"[^\x00-\x7f]+")
#: A whole word of non-ASCII letters: no ASCII letter beside it.
_WORD = re.compile(r"(?<![^\x00-\x40\x5b-\x60\x7b-\x7f])[^\x00-\x7f]+(?![A-Za-z])")
_LOST = "\ufffd"
_SEQUENCE = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


@dataclass(frozen=True)
class Reading:
    """A wrong reading. ``table``: a read character's byte of UTF-8, or the character it was written as."""

    name: str
    utf8: bool
    table: dict[str, int | str]

    @property
    def western(self) -> bool:
        """Whether hardly a letter of another script than Latin is read: then nearly no plain text is valid UTF-8, and a valid pair alone tells."""
        letters = [c for c in self.table if c.isalpha()]
        return sum(c < "\u0250" for c in letters) >= 0.9 * len(letters)


def undo(run: str, reading: Reading) -> str | None:
    """A run of non-ASCII characters with one wrong reading undone; None where it can't be one.

    A character cut off at the end of the run is dropped. What was read in a
    Western encoding is undone where it is valid, and stays where it isn't.
    """
    table = reading.table
    if not reading.utf8:
        out = "".join(table.get(c, "\0") for c in run)
        return None if "\0" in out or out == run else out
    try:
        raw = bytes([table[c] for c in run])
    except KeyError:
        if not reading.western:
            return None
        parts = re.split(f"([{re.escape(''.join(table))}]+)", run)
        new = [undo(p, reading) or p if k % 2 else p for k, p in enumerate(parts)]
        return "".join(new) if new != parts else None
    try:
        out = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data" and e.start >= 2:
            return raw[: e.start].decode("utf-8")
        if not reading.western or not _SEQUENCE.search(raw):
            return None
        at, new = 0, []
        for m in _SEQUENCE.finditer(raw):
            try:
                new += [run[at : m.start()], m.group().decode("utf-8")]
            except UnicodeDecodeError:
                new += [run[at : m.end()]]
            at = m.end()
        out = "".join([*new, run[at:]])
    return out if out != run else None


#: Pairs of characters are counted in so many buckets, single characters in so many more: what comes to the driver is bounded, whatever the alphabets.
BUCKETS, SINGLES = 1 << 18, 1 << 16


def _bucket(a: str, b: str) -> int:
    return (ord(a) * 40503 ^ ord(b) * 69069) % BUCKETS


class Language:
    """How likely characters follow each other, from counts of pairs; ``^`` and ``$`` are a run's edges."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = counts
        self.kinds = sum(k >= BUCKETS for k in counts) + 1
        self.memo: dict[str, float] = {}

    def cost(self, run: str) -> float:
        """Bits of surprise of a run of non-ASCII characters, in all."""
        got = self.memo.get(run)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            s, own, kinds = f"^{run.lower()}$", self.counts, self.kinds
            got = self.memo[run] = sum(math.log2((own.get(BUCKETS + ord(a) % SINGLES, 0) + kinds) / (own.get(_bucket(a, b), 0) + 0.5)) for a, b in zip(s, s[1:]))
        return got


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """(bucket, n): neighbouring characters of all runs of non-ASCII characters, and the first of each pair, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            runs: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    runs.update(_PART.findall(t))
            for r, n in runs.items():
                s = f"^{r.lower()}$"
                for x, y in zip(s, s[1:]):
                    total[_bucket(x, y)] += n
                    total[BUCKETS + ord(x) % SINGLES] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def language(df: DataFrame, text: str, rare: int = 2) -> Language:
    """The language of a column. Pairs seen fewer than ``rare`` times count as unseen.

    At most a number a bucket comes to the driver, a few megabytes.
    """
    return Language({r[0]: r[1] for r in pair_counts(df, text).where(F.col("n") >= rare).collect()})


class Restorer:
    """Finds the wrong readings of texts among ``readings``; UTF-8 is undone up to ``depth`` times in a row.

    UTF-8 read in a one-byte encoding shows by itself: its sequences must be
    valid, and the result be likelier or consist of fewer odd characters. One
    one-byte encoding read in another can only be told by the language: the
    pair that takes ``gain`` bits in all from words that lose ``share`` of their
    surprise is undone in every word that it makes likelier.
    """

    def __init__(self, lang: Language, readings: tuple[Reading, ...], depth: int = 3, gain: float = 22.0, share: float = 0.3) -> None:
        self.lang, self.depth, self.gain, self.share = lang, depth, gain, share
        self.utf8 = [r for r in readings if r.utf8]
        self.single = {r.name: r for r in readings if not r.utf8}
        self.memo8: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.memo1: dict[str, list[tuple[str, str, float]]] = {}

    def undo_utf8(self, run: str) -> tuple[str, tuple[str, ...]]:
        """A run with its wrong readings of UTF-8 undone, and which they were."""
        got = self.memo8.get(run)
        if got is None:
            if len(self.memo8) > 200_000:
                self.memo8.clear()
            now, undone = run, ()
            for _ in range(self.depth):
                best = None
                for read in self.utf8:
                    if (r := undo(now, read)) is not None and len(r) < len(now) and not any("\x80" <= c < "\xa0" for c in r if c not in now):
                        c = self.lang.cost(r)
                        if c < self.lang.cost(now) and (best is None or c < best[0]):
                            best = (c, r, read.name)
                if best is None:
                    break
                now, undone = best[1], (*undone, best[2])
            got = self.memo8[run] = (now, undone)
        return got

    def readings(self, word: str) -> list[tuple[str, str, float]]:
        """(pair, restored, bits gained) of each one-byte pair that makes a word likelier."""
        got = self.memo1.get(word)
        if got is None:
            if len(self.memo1) > 200_000:
                self.memo1.clear()
            cost, got = self.lang.cost(word), []
            if cost > 4.5 * (len(word) + 1):  # else as likely as plain words are
                for name, reading in self.single.items():
                    r = undo(word, reading)
                    if r is None or not all(c.isalpha() or c in "\u00ab\u00bb\u2014\u2013\u2019" for c in r):
                        continue
                    g = cost - self.lang.cost(r)
                    if g > self.share * cost:
                        got.append((name, r, g))
            self.memo1[word] = got
        return got

    def text(self, text: str) -> tuple[str, list[str]]:
        """A text restored, and the pairs undone in it, the most frequent first."""
        if text.isascii():
            return text, []
        pairs: Counter = Counter()

        def put(m: re.Match) -> str:
            r, undone = self.undo_utf8(m.group())
            pairs.update(undone)
            return r

        out = _PART.sub(put, text)
        gains: Counter = Counter()
        words = _WORD.findall(out) if self.single else []
        for w in words:
            for pair, _, g in self.readings(w):
                gains[pair] += g
        if gains:
            pair, g = max(gains.items(), key=lambda x: (x[1], x[0]))
            if g >= self.gain:
                likelier = lambda w, r: r if r is not None and self.lang.cost(r) < self.lang.cost(w) else w
                out = _WORD.sub(lambda m: likelier(m.group(), undo(m.group(), self.single[pair])), out)
                pairs[pair] += 1
        return out, [p for p, _ in pairs.most_common()]


_SENTENCE = re.compile(r"[^.!?\r\n]+")


def _pattern(values) -> bytes:
    """Which values are equal: each as the number of its first occurrence."""
    seen: dict = {}
    return b"".join(seen.setdefault(v, len(seen)).to_bytes(2) for v in values)


#: Two twins of characters say nothing with fewer different ones.
FEW = 8
#: About so many garbled sentences of one key meet its clean ones in one place; more are spread over several. Decides speed, never results.
BLOCK = 1000
#: Edges that a task holds before it gives them on.
HELD = 1_000_000


def twin_keys(sentence: str) -> tuple[int, int]:
    """The keys of a sentence as it stands, and as it would be if its UTF-8 were read in a one-byte encoding.

    Each is a hash of the text stripped of its non-ASCII characters, where
    those stood, and which of them are equal.
    """
    runs = _PART.findall(sentence)
    bare = _PART.sub("\0", sentence).encode()
    raw = [r.encode("utf-8", "surrogatepass") for r in runs]
    key = lambda parts, values: xxhash.xxh64_intdigest(b"\1".join((bare, repr([len(p) for p in parts]).encode(), _pattern(values)))) - (1 << 63)
    return key(runs, "".join(runs)), key(raw, b"".join(raw))


def _keyed(lang: Language, least: int):
    """Each task's distinct sentences with both keys: (own, read, several, cost, sentence); ``several``: of ``FEW`` different characters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                if t is None or t.isascii():
                    continue
                for x in _SENTENCE.findall(t):
                    x = x.strip(" ")
                    if len(x) < least or x.isascii() or _LOST in x:
                        continue
                    h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
                    if h in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(h)
                    runs = _PART.findall(x)
                    rows.append((*twin_keys(x), len(set("".join(runs))) >= FEW, sum(map(lang.cost, runs)), x))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["own", "read", "several", "cost", "sentence"])

    return run


@lru_cache(10_000)
def _values(sentence: str, utf8: bool) -> tuple[tuple[int | str, ...], int]:
    """The different characters, or bytes of UTF-8, of a sentence in order, and which of them is the most frequent."""
    joined = "".join(_PART.findall(sentence))
    n = Counter(joined.encode("utf-8", "surrogatepass") if utf8 else joined)
    values = tuple(n)
    return values, values.index(max(n, key=lambda k: (n[k], k)))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Twins as edges, pairs of read character and byte or written character, summed in each task; ``label`` is the edge of the clean twin's most frequent character or byte."""
    total: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def rows() -> pa.RecordBatch:
        cols = list(zip(*((utf8, f"{a}\0{b}", x, str(y), n) for (utf8, a, b), edges in total.items() for (x, y), n in edges.items())))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.string()) for c in cols[1:4]), pa.array(cols[4], pa.int64())], ["utf8", "label", "x", "y", "n"])

    for b in batches:
        for utf8, g, c in zip(*(x.to_pylist() for x in b.columns)):
            (xs, _), (ys, top) = _values(g, False), _values(c, utf8)
            if len(xs) != len(ys) or not utf8 and sum(map(ne, xs, ys)) < 0.8 * len(ys):
                continue
            total[utf8, xs[top], ys[top]].update(zip(xs, ys))
            held += len(ys)
            if held > HELD:
                yield rows()
                total.clear()
                held = 0
    if total:
        yield rows()


@cache
def known_tables() -> dict[str, dict[str, int]]:
    """Every one-byte encoding that extends ASCII: character to byte; bytes it leaves out stand for the control of that number."""
    out = {}
    for name in sorted({*encodings.aliases.aliases.values(), "cp1252", "latin_1"}, key=lambda n: (n not in ("cp1252", "latin_1", "cp1251", "koi8_r", "cp866"), n)):
        try:
            if bytes(range(32, 127)).decode(name) != bytes(range(32, 127)).decode("ascii") or len(bytes([0xE0]).decode(name, "ignore")) != 1:
                continue
            table = {bytes([b]).decode(name, "ignore") or chr(b): b for b in range(128, 256)}
        except (LookupError, UnicodeError):
            continue
        if len(table) == 128 and not any(k.isascii() for k in table):
            out[name.replace("_", "-")] = table
    return out


def _explained(votes: Counter, utf8: bool) -> tuple[str, dict[str, int | str]] | None:
    """The known encodings, read and written, that explain most of the votes (x, y): their names and table; ties go to the first known."""
    best = None
    reads = {n: t for n, t in known_tables().items() if sum(v for (x, _), v in votes.items() if x in t) * 20 > sum(votes.values())}
    if utf8:
        for read, table in reads.items():
            n = sum(v for (x, y), v in votes.items() if str(table.get(x)) == y)
            if best is None or n > best[0]:
                best = (n, f"{read}>utf-8", table)
    else:
        for written, other in known_tables().items():
            back = {b: c for c, b in other.items()}
            if sum(v for (_, y), v in votes.items() if y in other) * 20 > sum(votes.values()):
                for read, table in reads.items():
                    n = sum(v for (x, y), v in votes.items() if x in table and back.get(table[x]) == y)
                    if read != written and (best is None or n > best[0]):
                        best = (n, f"{read}>{written}", {x: back[b] for x, b in table.items() if b in back})
    return best[1:] if best else None


def _readings(votes: Counter, utf8: bool, number: int, least: float = 0.04) -> list[Reading]:
    """The readings behind the votes (x, y) of labels that agree.

    Known encodings explain votes, those that explain most first, as long as
    they explain a share of ``least`` and more than a few characters. What no
    known one explains makes a table of its own, if it speaks with one voice.
    """
    out, all_n = [], sum(votes.values())
    few = 3 if utf8 else 8
    while votes and (told := _explained(votes, utf8)) is not None:
        name, table = told
        own = {k: n for k, n in votes.items() if str(table.get(k[0])) == k[1]}
        if len(own) < few or sum(own.values()) < least * all_n:
            break
        out.append(Reading(name, utf8, table))
        votes = Counter({k: n for k, n in votes.items() if k not in own})
    seen: dict[str, Counter] = defaultdict(Counter)
    for (x, y), n in votes.items():
        seen[x][y] += n
    first = {x: ys.most_common(1)[0] for x, ys in seen.items()}
    left = sum(votes.values())
    if len(first) >= few and left > 0.3 * all_n and sum(n for _, n in first.values()) > 0.95 * left:
        out.append(Reading(f"learned-{number}>{'utf-8' if utf8 else 'plain'}", utf8, {x: int(y) if utf8 else y for x, (y, _) in first.items()}))
    return out


def learned_readings(df: DataFrame, text: str, lang: Language, min_twins: int = 2, least: int = 12, share: float = 0.3) -> tuple[Reading, ...]:
    """The wrong readings that the corpus shows, by aligning garbled sentences with their clean twins.

    Within a key every sentence is aligned with every other that takes ``share`` of
    its surprise off, as garbled with clean: all readings of a sentence show, and
    all clean sentences of a key are partners. Keys are first brought down to one
    small row a task; sentences of keys without such a pair aren't moved. The
    garbled ones of a large key are spread in blocks of ``BLOCK``, each of which
    meets all its clean ones, so that pairs, which grow with the square of a key's
    distinct sentences, are made in many places and never stored. Sentences have
    at least ``least`` characters. The edges of all alignments are summed by a
    label, and labels whose tables agree are one reading; it stands with at least
    ``min_twins`` twins. What comes to the driver is a row for each label and pair
    of characters, no row a record: with one-byte alphabets their number is bounded.
    """
    every = checkpointed(df.where(F.col(text).isNotNull()).select(text).mapInArrow(_keyed(lang, least), "own long, read long, several boolean, cost double, sentence string"))
    own, read = (every.select(F.col(k).alias("key"), F.lit(k == "read").alias("utf8"), (F.col("several") | F.lit(k == "read")).alias("partner"), "cost", "sentence") for k in ("own", "read"))
    both = own.unionAll(read)
    keys = both.groupBy("key").agg(F.max(F.when(~F.col("utf8"), F.col("cost"))).alias("worst"), F.min(F.when(F.col("partner"), F.col("cost"))).alias("best"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    keys = keys.where(F.col("best") <= (1 - share) * F.col("worst"))
    garbled = own.join(keys, "key").where(F.col("best") <= (1 - share) * F.col("cost")).select("key", F.pmod(F.xxhash64("sentence"), F.col("blocks")).cast("int").alias("block"), F.col("cost").alias("g_cost"), F.col("sentence").alias("garbled")).distinct()
    clean = both.where("partner").join(keys, "key").where(F.col("cost") <= (1 - share) * F.col("worst")).select("key", "utf8", "cost", F.col("sentence").alias("clean"), "blocks").distinct()
    clean = clean.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "utf8", "cost", "clean")
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism  # a number that is told isn't brought down by how few bytes come in
    twins = garbled.repartition(parts, "key", "block").join(clean.repartition(parts, "key", "block"), ["key", "block"]).where((F.col("cost") <= (1 - share) * F.col("g_cost")) & (F.col("garbled") != F.col("clean"))).select("utf8", "garbled", "clean")
    edges = twins.mapInArrow(_aligned, "utf8 boolean, label string, x string, y string, n long").groupBy("utf8", "label", "x", "y").agg(F.sum("n").alias("n")).collect()
    tables: dict[tuple[bool, str], dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    twins_of: Counter = Counter()
    for utf8, label, x, y, n in edges:
        tables[utf8, label][x][y] += n
        if label == f"{x}\0{y}":
            twins_of[utf8, label] += n
    groups: list[list] = []
    for k in sorted(tables, key=lambda k: (-twins_of[k], k)):
        best = None
        for g in groups:
            if g[0] == k[0]:
                both = [(ys.most_common(1)[0], g[2][x].most_common(1)[0][0]) for x, ys in tables[k].items() if x in g[2]]
                agree = sum(n for (y, n), z in both if y == z)
                if len(both) >= min(8, len(tables[k]) // 2) and agree > 0.95 * sum(n for (_, n), _ in both) and (best is None or agree > best[0]):
                    best = (agree, g)
        if best is None:
            groups.append([k[0], twins_of[k], tables[k]])
        else:
            best[1][1] += twins_of[k]
            for x, ys in tables[k].items():
                best[1][2][x] += ys
    found: dict[str, Reading] = {}
    for i, (utf8, n, votes) in enumerate(groups):
        if n >= min_twins:
            for r in _readings(Counter({(x, y): n for x, ys in votes.items() for y, n in ys.items()}), utf8, i):
                found.setdefault(r.name, r)
    return tuple(found.values())


def _restore(lang: Language, readings: tuple[Reading, ...], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(lang, readings)
        for b in batches:
            keep, out, undone = [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                new, p = r.text(t)
                if p or _LOST in t:
                    keep.append(i)
                    out.append(new)
                    undone.append(p)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), pa.array(out, pa.string()), pa.array(undone, pa.list_(pa.string()))], [*names, "restored", "undone"])

    return run


def find_garbled(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, restored, undone): the rows whose text was read wrongly somewhere.

    ``restored`` is the text with every wrong reading undone that can be;
    ``undone`` names the encodings read and written. Where
    characters were lost (replacement characters, which only a wrong reading
    leaves) the row comes out with those in place. Null, empty and ASCII texts
    are no cases, nor are foreign letters in place: undoing a reading must make
    the text likelier by the corpus's own language. Repeated rows come out
    repeated.
    """
    lang = language(df, text)
    readings = learned_readings(df, text, lang)
    src = df.where(F.col(text).isNotNull()).select(*keys, text)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name in keys)
    return src.mapInArrow(_restore(lang, readings, keys), f"{fields}restored string, undone array<string>")
