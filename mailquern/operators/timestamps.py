"""Timestamps of mixed formats, precisions and zones as instants in UTC.

Texts are parsed in Arrow batches: as expressions, the forms together exceed
what a method of generated code can hold. All that follows is expressions. A text with an offset, a zone name or
plain digits means an instant; one without is local to a group's clock (an
organisation, a host). The zone of each clock is estimated: of all offset
histories of the zone database the one is taken under which the fewest of the
group's local times lie outside the span that aligned times (ingestion, the same
moment noted elsewhere, the neighbours in a sequence) allow. A declared zone
only decides between histories that do equally well.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Iterator
from datetime import UTC, date, datetime
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Zone abbreviations of mail headers and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_CLOCK = r"(?P<h>\d\d?):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,]\d+)?)?"
_OFFSET = r"(?P<off>(?:UTC|GMT)?[+-]\d\d:?\d\d|[A-Za-z]{1,5})"
#: Each form of a time; white space is one blank by then.
FORMS = tuple(
    re.compile(p, re.ASCII)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<m>\d\d)-(?P<d>\d\d)[T ]{_CLOCK} ?{_OFFSET}?(?: ?\[(?P<zone>[A-Za-z0-9_+/-]+)\])?",
        rf"(?:[A-Za-z]{{3}}, ?)?(?P<d>\d\d?) (?P<m>[A-Za-z]{{3}}) (?P<y>\d{{4}}) {_CLOCK}(?: {_OFFSET})?(?: \(.*\))?",
        rf"(?P<d>\d\d?)\.(?P<m>\d\d?)\.(?P<y>\d{{4}}),? {_CLOCK}",
        rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?:[.,]\d+)?{_OFFSET}?",
        rf"(?P<m>\d\d?)/(?P<d>\d\d?)/(?P<y>\d{{4}}),? {_CLOCK}(?: (?P<half>[AaPp][Mm]))?",
        rf"[A-Za-z]{{3}} (?P<m>[A-Za-z]{{3}}) (?P<d>\d\d?) {_CLOCK} (?:{_OFFSET} )?(?P<y>\d{{4}})",
    )
)
_DIGITS = re.compile(r"\d{9,19}", re.ASCII)
_EPOCH = date(1970, 1, 1).toordinal()
PARSED = ("secs", "local", "zone", "minute")
_NONE = (None, None, None, None)


def parse_text(text: str | None) -> tuple[int | None, bool | None, str | None, bool | None]:
    """(secs, local, zone, minute) of one text, all None where it is no time."""
    if not text:
        return _NONE
    t = " ".join(text.split())
    if _DIGITS.fullmatch(t):
        unit = 1 if len(t) <= 11 else 10**3 if len(t) <= 14 else 10**6 if len(t) <= 17 else 10**9
        return int(t) // unit, False, None, False
    for form in FORMS:
        if m := form.fullmatch(t):
            break
    else:
        return _NONE
    g = m.groupdict()
    month = int(g["m"]) if g["m"].isdigit() else MONTHS.get(g["m"].lower(), 0)
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if half := g.get("half"):
        if not 1 <= h <= 12:
            return _NONE
        h = h % 12 + (12 if half.lower() == "pm" else 0)
    if h > 23 or mi > 59 or s > 60:
        return _NONE
    try:
        clock = (date(int(g["y"]), month, int(g["d"])).toordinal() - _EPOCH) * 86400 + h * 3600 + mi * 60 + s
    except ValueError:
        return _NONE
    off, minutes = g.get("off"), None
    if off:
        if off[-1].isdigit():
            n = off.replace(":", "")
            minutes = (-1 if "-" in n else 1) * (int(n[-4:-2]) * 60 + int(n[-2:]))
        else:
            minutes = ABBREVIATIONS.get(off.upper())
    if minutes is not None:
        return clock - minutes * 60, False, None, g["s"] is None
    return clock, True, g.get("zone"), g["s"] is None


def parse_time(df: DataFrame, **texts: str) -> DataFrame:
    """``df`` with {to}_secs, {to}_local, {to}_zone and {to}_minute for each ``to=text column``, null where that is no time.

    ``secs``: whole seconds since 1970, of the instant or, if ``local``, of the
    clock. ``zone``: a zone named in the text. ``minute``: the text has no
    seconds. Dotted dates put the day first, slashed ones the month; digits
    count from 1970 in seconds, or in milli-, micro- or nanoseconds by their
    number. Offsets come before zone names; an unknown abbreviation leaves the
    time local. Dates that don't exist are no times. The text columns go.
    """
    kept = [c for c in df.columns if c not in texts.values()]
    kinds = {"secs": (pa.int64(), "long"), "local": (pa.bool_(), "boolean"), "zone": (pa.string(), "string"), "minute": (pa.bool_(), "boolean")}
    names = [*kept, *(f"{to}_{x}" for to in texts for x in PARSED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(len(kept))]
            for i in range(len(kept), b.num_columns):
                parsed = [parse_text(x) for x in b.column(i).to_pylist()]
                cols += [pa.array([p[k] for p in parsed], kinds[x][0]) for k, x in enumerate(PARSED)]
            yield pa.RecordBatch.from_arrays(cols, names)

    src = df.select(*kept, *(F.col(c).cast("string") for c in texts.values()))
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"`{to}_{x}` {kinds[x][1]}" for to in texts for x in PARSED)])
    return src.mapInArrow(run, schema)


def received_date(raw: Column) -> Column:
    """The text after the last ``;`` of a Received line, null if there is none."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(raw, r"(?s);([^;]*)$", 1), r"\s+", " ")), F.lit(""))


def _shift(f, secs: Column, zone: Column | str) -> Column:
    """Seconds moved between a zone's clock and UTC; the session's zone takes no part."""
    return F.unix_seconds(f(F.timestamp_seconds(secs), zone if isinstance(zone, Column) else F.lit(zone)))


def instants(df: DataFrame, time: str, zone: str, to: str) -> DataFrame:
    """``df`` with the array ``to``: the instants that the parsed time columns {time}_... can mean.

    One as a rule, two of a local time that occurred twice, none of one that
    never did; null where there is no time, or no zone for a local one. Tried
    are the offsets of the zone a day before and a day after.
    """
    kept = df.columns
    secs, local = F.col(f"{time}_secs"), F.col(f"{time}_local")
    d = df.withColumn("__z", F.when(local, F.coalesce(f"{time}_zone", zone)))
    d = d.withColumn("__u", F.when(local, _shift(F.to_utc_timestamp, secs, F.col("__z"))))
    around = [F.col("__u") + secs - _shift(F.from_utc_timestamp, F.col("__u") + day, F.col("__z")) + day for day in (-86400, 86400)]
    tries = F.array_distinct(F.array(*around, F.col("__u")))
    meant = F.filter(tries, lambda t: _shift(F.from_utc_timestamp, t, F.col("__z")) == secs)
    return d.select(*kept, F.when(~local, F.array(secs)).when(F.col("__u").isNotNull(), meant).alias(to))


QUARTER = 900


@cache
def offset_histories(first: int = 1970, last: int = 2045) -> tuple[np.ndarray, np.ndarray, tuple[tuple[str, ...], ...]]:
    """(edges, offsets, names): the distinct offset histories of the zone database between two years.

    ``edges``: the instants at which any zone changes; ``offsets``: a row a
    history, a column a segment between edges, in quarters of an hour;
    ``names``: the zones of each history. Changes are sought every four weeks
    and then halved down to a second.
    """
    at = lambda z, t: int(datetime.fromtimestamp(t, z).utcoffset().total_seconds())
    start, end = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (first, last))
    changes: dict[str, list[tuple[int, int]]] = {}
    for name in sorted(zoneinfo.available_timezones()):
        zone = zoneinfo.ZoneInfo(name)
        now = at(zone, start)
        told = [(start, now)]
        for t in range(start, end, 28 * 86400):
            if (then := at(zone, t + 28 * 86400)) != now:
                lo, hi = t, t + 28 * 86400
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if at(zone, mid) == now else (lo, mid)
                told.append((hi, then))
                now = then
        changes[name] = told
    edges = np.array(sorted({t for told in changes.values() for t, _ in told}), np.int64)
    by_history: dict[bytes, tuple[np.ndarray, list[str]]] = {}
    for name, told in changes.items():
        row = np.empty(len(edges), np.int16)
        for t, offset in told:
            row[np.searchsorted(edges, t) :] = offset // QUARTER
        by_history.setdefault(row.tobytes(), (row, []))[1].append(name)
    return edges, np.array([r for r, _ in by_history.values()]), tuple(tuple(n) for _, n in by_history.values())


def _votes(edges: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which offsets each row allows, counted in each batch: (group, segment, quarter, n)."""
    for b in batches:
        secs, aligned, early, late = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
        lag = secs - aligned
        lo, hi = -((early - lag) // QUARTER), (lag + late) // QUARTER
        segment = np.maximum(np.searchsorted(edges, aligned, side="right") - 1, 0)
        group = b.column(0).to_pandas()
        parts = []
        for k in range(int(max(0, (hi - lo).max(initial=-1))) + 1):
            ok = (lo + k <= hi) & (np.abs(lo + k) <= 64)
            parts.append(pd.DataFrame({"group": group[ok], "segment": segment[ok], "quarter": (lo + k)[ok]}))
        if parts:
            n = pd.concat(parts).groupby(["group", "segment", "quarter"]).size().reset_index(name="n")
            yield pa.RecordBatch.from_pandas(n.astype({"segment": "int32", "quarter": "int32", "n": "int64"}), preserve_index=False)


def _best(offsets: np.ndarray, names: tuple[tuple[str, ...], ...], min_rows: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """The zone of one group from its votes, of which there are no more than segments times quarters of an hour."""
    declared, votes = pdf["declared"].iloc[0], pdf[pdf["n"].notna()]
    good = np.zeros(len(offsets), np.int64)
    for segment, quarter, n in votes[["segment", "quarter", "n"]].astype(np.int64).itertuples(index=False):
        good += np.where(offsets[:, segment] == quarter, n, 0)
    best = int(good.max())
    own = next((i for i, zones in enumerate(names) if declared in zones), None)
    if isinstance(declared, str) and declared and (best < min_rows or own is not None and good[own] >= best - max(1, best // 100)):
        zone = declared
    else:
        zone = min(names[i][0] for i in np.flatnonzero(good == best)) if best else None
    return pd.DataFrame({"group": pdf["group"].iloc[:1], "zone": [zone]})


def estimate_zones(spoken: DataFrame, declared: DataFrame, min_rows: int = 20) -> DataFrame:
    """(group, zone): the zone of each group's clock.

    ``spoken`` has group, secs (a local time, seconds since 1970 of the clock),
    aligned (an instant) and early and late: the time violates a zone if the
    instant it would mean lies more than ``late`` seconds before ``aligned`` or
    more than ``early`` after it. Of all offset histories of the zone database
    the one with the fewest violations is taken. ``declared`` (group, zone)
    decides where its history does as well but for one in a hundred, and where
    fewer than ``min_rows`` rows agree on anything; else ties go to the first
    zone by name. Groups without rows keep what is declared. Null groups are
    left out.

    Rows are counted by the offsets they allow in each task, so a group of a
    third of all rows moves as a few small rows.
    """
    edges, offsets, names = offset_histories()
    fields = "group string, segment int, quarter int, n long"
    votes = spoken.dropna().select(F.col("group").cast("string"), "secs", "aligned", "early", "late").mapInArrow(lambda batches: _votes(edges, batches), fields)
    votes = votes.groupBy("group", "segment", "quarter").agg(F.sum("n").alias("n"))
    told = declared.select(F.col(declared.columns[0]).alias("group"), F.col(declared.columns[1]).alias("declared")).where(F.col("group").isNotNull()).groupBy("group").agg(F.min("declared").alias("declared"))
    return votes.join(told, "group", "full").groupBy("group").applyInPandas(lambda pdf: _best(offsets, names, min_rows, pdf), "group string, zone string")


def same_instant(a: Column, b: Column, minute: Column) -> Column:
    """Whether two arrays of instants share one, by whole seconds, or by whole minutes where ``minute`` says so."""
    whole = lambda xs: F.transform(xs, lambda t: F.when(minute, F.floor(t / 60) * 60).otherwise(t).cast("long"))
    return F.arrays_overlap(whole(a), whole(b))


def normalised_submissions(submissions: DataFrame, orgs: DataFrame) -> DataFrame:
    """(submission_id, time_..., meant): each submission's reception as the instants it can mean.

    The time columns are null where the text is missing or no time; ``meant``
    is empty where the clock never showed that time. Repeated rows of one key
    are one. Orgs are aligned by when their submissions were stored, at most a
    quarter of an hour later.
    """
    src = submissions.where(F.col("submission_id").isNotNull()).dropDuplicates(["submission_id"]).select("submission_id", "org_id", "received_at", "created_at")
    stored = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("created_at").cast("timestamp_ntz"))
    parsed = parse_time(src.select("submission_id", "org_id", "received_at", stored.alias("stored")), time="received_at")
    spoken = parsed.where(F.col("time_local") & F.col("time_zone").isNull()).select(F.col("org_id").alias("group"), F.col("time_secs").alias("secs"), F.col("stored").alias("aligned"), F.lit(60).alias("early"), F.lit(900).alias("late"))
    zones = estimate_zones(spoken, orgs.select("org_id", "tz_name")).withColumnRenamed("group", "org_id")
    return instants(parsed.join(zones, "org_id", "left"), "time", "zone", "meant").select("submission_id", *(f"time_{x}" for x in PARSED), "meant")


def normalised_hops(hops: DataFrame, hosts: DataFrame) -> DataFrame:
    """(hop_id, noted_..., raw_..., noted_meant, raw_meant): both recorded times of each hop as instants.

    A host's clock is aligned by hops of which one time has a zone and the other
    has none; and, where no time of a hop has one, by the sequence: the hops
    before and after it in the same message, at most a quarter of an hour away.
    """
    src = hops.where(F.col("hop_id").isNotNull()).dropDuplicates(["hop_id"]).select("hop_id", "submission_id", "hop_no", "by_host", "hop_ts", received_date(F.col("hop_raw")).alias("hop_raw"))
    parsed = parse_time(src, noted="hop_ts", raw="hop_raw")
    own = F.col("by_host").alias("group")
    mixed = parsed.where(F.col("noted_local") != F.col("raw_local"))
    zoned = F.when(F.col("noted_local"), F.col("noted_zone")).otherwise(F.col("raw_zone"))
    same = mixed.where(zoned.isNull()).select(own, F.when(F.col("noted_local"), F.col("noted_secs")).otherwise(F.col("raw_secs")).alias("secs"), F.when(F.col("noted_local"), F.col("raw_secs")).otherwise(F.col("noted_secs")).alias("aligned"), F.lit(60).alias("early"), F.lit(60).alias("late"))
    known = F.coalesce(F.when(~F.col("noted_local"), F.col("noted_secs")), F.when(~F.col("raw_local"), F.col("raw_secs")))
    placed = parsed.where(F.col("submission_id").isNotNull() & F.col("hop_no").isNotNull())
    beside = placed.where(known.isNotNull()).groupBy("submission_id", F.col("hop_no").alias("beside")).agg(F.min(known).alias("aligned"))
    alone = placed.where(known.isNull() & F.coalesce("noted_local", "raw_local").isNotNull() & F.coalesce("noted_zone", "raw_zone").isNull())
    near = alone.select(own, F.coalesce("noted_secs", "raw_secs").alias("secs"), "submission_id", F.explode(F.array(F.col("hop_no") - 1, F.col("hop_no") + 1)).alias("beside"), "hop_no").join(beside, ["submission_id", "beside"])
    earlier = F.col("beside") > F.col("hop_no")  # the first hop has the largest number
    sequence = near.select("group", "secs", "aligned", F.when(earlier, 900).otherwise(60).alias("early"), F.when(earlier, 60).otherwise(900).alias("late"))
    zones = estimate_zones(same.unionByName(sequence), hosts.select("host_name", "tz_name")).withColumnRenamed("group", "by_host")
    d = parsed.drop("submission_id", "hop_no").join(zones, "by_host", "left")
    return instants(instants(d, "noted", "zone", "noted_meant"), "raw", "zone", "raw_meant").drop("by_host", "zone")
