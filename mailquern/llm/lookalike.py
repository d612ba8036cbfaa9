"""Text that looks the same but is written with other characters: one written form, and a key by which such texts meet.

The form is made in two steps. Characters that show nothing go, kinds of blank
and of hyphen and wide or mathematical letter styles become the plain
character, and marks are composed. Then each token that mixes scripts is
repaired: its dominant script is found, foreign letters become the look-alikes
of that script, and the result stands if the corpus holds it as a word. A token
whose every letter could be of another script mixes nothing by itself; it mixes
with its line, and is repaired to the line's dominant script by the same rule.

``shape`` folds the letters of all scripts that share their shape, vocabulary
or not. It serves other operators to compare words; here nothing comes out by
it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from mailquern.session import checkpointed

#: Letters of other scripts that have the shape of a Latin letter.
SHAPES = {
    "Cyrillic": ("аԁеһіјӏорԛѕсуԝхѵАВЕԌНІЈКМОРԚЅСТУԜХҮѴӀ", "adehijlopqscywxvABEGHIJKMOPQSCTYWXYVI"),
    "Greek": ("οναιρυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ovaipucjABEZHIKMNOPTYXC"),
    "Armenian": ("օսհոցզյքԼՕՏՍ", "ouhngqjpLOSU"),
}
#: Plain Latin letters in another style that has no decomposition, and kinds of hyphen.
LETTERS = {"ɡ": "g", "ɑ": "a", "ı": "i"}
HYPHENS = "‐‑⁃﹣－"
#: Characters that show nothing besides the format characters.
SILENT = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10))) + "\u180b\u180c\u180d"

_to_latin = {a: b for s, t in SHAPES.values() for a, b in zip(s, t)}
_from_latin = {script: {b: a for a, b in reversed(list(zip(s, t)))} for script, (s, t) in SHAPES.items()}


@cache
def _styles() -> dict[int, str | None]:
    """What each character becomes before composing; made from the character database by rule."""
    out: dict[int, str | None] = {}
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        kind = unicodedata.category(c)
        if kind == "Cf" or c in SILENT:
            out[o] = None
        elif kind == "Zs":
            out[o] = " "
        elif c in HYPHENS:
            out[o] = "-"
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")):
            out[o] = unicodedata.normalize("NFKC", c)
    out.pop(ord(" "), None)
    return out


def _ranges(chars: list[int]) -> str:
    """Sorted code points as the inside of a character class."""
    out: list[list[int]] = []
    for o in chars:
        if out and o == out[-1][1] + 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


@cache
def _odd() -> re.Pattern:
    """Finds any character that the first step changes; the wide blocks stand whole."""
    return re.compile(f"[{_ranges(sorted(_styles()))}]")


def plain(text: str) -> str:
    """The first step: what shows nothing goes, styles become plain, marks are composed."""
    if text.isascii():
        return text
    if _odd().search(text) is not None:
        text = text.translate(_styles())
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


_shape_table = {ord(a): b for a, b in (_to_latin | LETTERS).items()}
_MARK = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]")


@cache
def _whole_shapes() -> dict[int, str]:
    """The shape table with composed letters, each as its marks and the shape of its letter."""
    out = {o: unicodedata.normalize("NFD", chr(o)).translate(_shape_table) for a, b in ((0xC0, 0x590), (0x1E00, 0x2000)) for o in range(a, b)}
    return {o: t for o, t in (out | _shape_table).items() if t != chr(o)}


def shape(text: str) -> str:
    """The second step's comparison form of plain text: letters of one shape become one letter, marks stand apart."""
    if text.isascii():
        return text
    if _MARK.search(text) is None:
        return text.translate(_whole_shapes())
    return unicodedata.normalize("NFD", text).translate(_shape_table)


def shape_key(text: str) -> str:
    return shape(text if text.isascii() else plain(text))


_SCRIPTS = {s: regex.compile(rf"\p{{{s}}}") for s in ("Latin", *SHAPES)}
#: A token: letters, digits and the marks on them.
_TOKEN = re.compile(r"(?:[^\W_]|[\u0300-\u036f\u0483-\u0487])+")
_LATIN_ALIKE = {t for table in _from_latin.values() for t in table}


@cache
def _script(c: str) -> str | None:
    return next((s for s, p in _SCRIPTS.items() if p.match(c)), None)


def _is_certain(c: str) -> bool:
    """Whether a letter can be of no other of the scripts."""
    return c not in LETTERS and (c not in _LATIN_ALIKE if _script(c) == "Latin" else c not in _to_latin)


_BLOCKS = {"Latin": ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x1E00, 0x1F00)), "Cyrillic": ((0x400, 0x530),), "Greek": ((0x370, 0x400), (0x1F00, 0x2000)), "Armenian": ((0x530, 0x590),)}
#: Letters of each script, and of these the certain ones.
_ANY = {s: re.compile(f"[{_ranges([o for a, b in ab for o in range(a, b) if _script(chr(o)) == s])}]") for s, ab in _BLOCKS.items()}
_CERTAIN = {s: re.compile(f"[{_ranges([o for a, b in ab for o in range(a, b) if _script(chr(o)) == s and _is_certain(chr(o))])}]") for s, ab in _BLOCKS.items()}


def _spelled(token: str, best: str) -> str | None:
    """A token with the letters of other scripts, and of other styles, as look-alikes of ``best``; None if one has none."""
    out = []
    for c in token:
        s = _script(c)
        if s is None or s == best and c not in LETTERS:
            out.append(c)
            continue
        latin = LETTERS.get(c, c) if s == "Latin" else _to_latin.get(c)
        other = latin if best == "Latin" else _from_latin[best].get(latin) if latin else None
        if other is None:
            return None
        out.append(other)
    return unicodedata.normalize("NFC", "".join(out))


def _dominant(token: str) -> tuple[str | None, bool]:
    """The dominant script of a token, and whether a letter decides that can be of no other; (None, False) without letters."""
    scripts = [(c, s) for c in token if (s := _script(c))]
    if not scripts:
        return None, False
    kinds, certain = Counter(s for _, s in scripts), Counter(s for c, s in scripts if _is_certain(c))
    return max(_SCRIPTS, key=lambda s: (certain[s], kinds[s])), bool(certain)


def _mixes(token: str) -> bool:
    return len({s for c in token if (s := _script(c))}) > 1 or any(c in LETTERS for c in token)


def repair(token: str) -> str | None:
    """A mixed-script token in its dominant script; None if it mixes nothing or a letter has no look-alike there.

    Letters that no other script can show decide first; a tie of scripts goes
    to the script of more letters, then to the first of Latin, Cyrillic, Greek
    and Armenian. Latin letters in another style that has no decomposition count
    as mixed in, too.
    """
    if not _mixes(token):
        return None
    out = _spelled(token, _dominant(token)[0])
    return out if out != token else None


class Repairs:
    """Finds the places of a text that a repair may change. What is told of tokens is kept, up to a number of them."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[bool, str | None, bool]] = {}

    def told(self, token: str) -> tuple[bool, str | None, bool]:
        """(doubtful, repaired, mixes): doubtful tokens have no certain letter and go by their line."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            best, certain = _dominant(token)
            got = self.memo[token] = (best is not None and not certain, repair(token), _mixes(token))
        return got

    @staticmethod
    def line_script(line: str) -> str | None:
        """The script of most letters of a line that can be of no other script; None without any."""
        n = {s: len(p.findall(line)) for s, p in _CERTAIN.items()}
        best = max(n, key=n.get)
        return best if n[best] else None

    def places(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, repaired) of plain text's tokens that mix scripts by themselves or with their line.

        A token with a certain letter goes by itself, any other by its line, a
        line without certain letters by the whole text, and a mixed token of a
        text without any by its own majority; where that script can't spell it,
        a mixed token goes by the first script that can.
        """
        if text.isascii():
            return []
        out, at, whole = [], 0, ""
        for line in text.splitlines(keepends=True):
            if line.isascii() and _CERTAIN["Latin"].search(line) is not None:
                at += len(line)
                continue
            script = self.line_script(line)
            if script is None:
                whole = self.line_script(text) if whole == "" else whole
                script = whole
            if any(p.search(line) is not None for s, p in _ANY.items() if s != script) or any(c in line for c in LETTERS):
                for m in _TOKEN.finditer(line):
                    t = m.group()
                    doubtful, r, mixes = self.told(t)
                    if doubtful and script is not None:
                        r = _spelled(t, script) or r
                    if r is None and mixes:
                        r = next((x for s in _SCRIPTS if (x := _spelled(t, s)) is not None), None)
                    if r is not None and r != t:
                        out.append((at + m.start(), at + m.end(), r))
            at += len(line)
        return out


def put(text: str, places: list[tuple[int, int, str]]) -> str:
    """A text with the repaired forms put in their places, marks composed."""
    out, at = [], 0
    for a, b, r in places:
        out += [text[at:a], r]
        at = b
    return "".join([*out, text[at:]])


def digest(s: str) -> bytes:
    return blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


PLACE = "array<struct<a:int,b:int,token:string,repaired:string>>"
_PLACE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("token", pa.string()), ("repaired", pa.string())]))


def _scan(names: list[str], all_texts: bool, strip: bool):
    """Per text: its plain form (or only where that or a repair changes it), that form's hash, and the places of repairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Repairs()
        for b in batches:
            plains, keys, found = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                p = plain(t)
                if strip:
                    p = p.strip()
                places = find.places(p)
                plains.append(p if all_texts or places or p != t else None)
                keys.append(digest(p))
                found.append([{"a": x, "b": y, "token": p[x:y], "repaired": r} for x, y, r in places])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(plains, pa.string()), pa.array(keys, pa.binary()), pa.array(found, _PLACE)], [*names, "canonical", "form", "places"])

    return run


def _repaired(names: list[str], all_texts: bool):
    """Puts the repairs that stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo = b.column(b.num_columns - 1).to_pylist()
            done = [put(t, [(x["a"], x["b"], x["repaired"]) for x in sorted(p, key=lambda x: x["a"])]) for t, p in zip(b.column(b.num_columns - 2).to_pylist(), todo)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(done if all_texts else [None] * len(done), pa.string()), pa.array(map(digest, done), pa.binary())], [*names, "canonical", "form"])

    return run


def words(c: Column) -> Column:
    return F.explode(F.split(c, r"[^\p{L}\p{M}\p{N}]+"))


def canonical(df: DataFrame, keys: list[str], text: str, all_texts: bool = True, strip: bool = False) -> DataFrame:
    """(keys, canonical, form): each non-null text in its one written form, and a 128-bit hash of that form.

    Tokens that mix scripts, by themselves or with their line, are repaired
    where the repaired form is in the corpus vocabulary: a word of this column
    in any row, or what two different spellings are repaired to. Without ``all_texts`` only the hash
    comes out. With ``strip`` blanks at the ends of a text show nothing. Rows
    with null texts are left out; empty texts stay; repeated rows come out
    repeated. Columns other than those named aren't read.

    The texts are scanned once and the result is written; only the rows that
    have such tokens are shuffled. The vocabulary is counted with a map-side
    combine and cut to the wanted words.
    """
    src = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name != "__text")
    scanned = checkpointed(src.mapInArrow(_scan(keys, all_texts, strip), f"{fields}canonical string, form binary, places {PLACE}").withColumn("__row", F.monotonically_increasing_id()))
    rows = scanned.where(F.size("places") > 0)
    places = rows.select("__row", F.explode("places").alias("p"))
    wanted = places.select("p.repaired", "p.token").groupBy("repaired").agg((F.min("token") != F.max("token")).alias("agreed"))
    changed = scanned.where(F.col("canonical").isNotNull())
    held = changed.select(words(F.col("canonical")).alias("repaired")) if all_texts else src.select(words(F.col("__text")).alias("repaired")).unionByName(changed.select(words(F.col("canonical")).alias("repaired")))
    stands = wanted.where("agreed").select("repaired").unionByName(wanted.where("NOT agreed").select("repaired").join(held.distinct(), "repaired", "left_semi"))
    todo = places.select("__row", "p", F.col("p.repaired").alias("repaired")).join(stands, "repaired", "left_semi").groupBy("__row").agg(F.collect_list("p").alias("todo"))
    put_in = rows.join(todo, "__row", "left").select(*keys, "canonical", F.coalesce("todo", F.array().cast(PLACE)).alias("todo"))
    done = put_in.mapInArrow(_repaired(keys, all_texts), f"{fields}canonical string, form binary")
    return scanned.where(F.size("places") == 0).select(*keys, "canonical", "form").unionByName(done)
