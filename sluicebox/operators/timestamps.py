"""Timestamps of mixed formats and zones brought to UTC microseconds.

One compiled alternation recognises every format and takes the components out in one match; the
calendar checks and the day arithmetic then run on integer columns of a whole Arrow batch. Local
times are resolved against the transitions of their zone; one that occurs twice or never is no
instant. Nothing is shuffled; the small table of feed zones is joined by broadcast when it is small.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Month names, and the zone letters with their usual offsets in hours.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ZONE_HOURS = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CET": 1, "CEST": 2}

_MONTH = "|".join(sorted({*MONTHS, *FULL_MONTHS}, key=lambda m: (-len(m), m)))
_DATES = rf"""
    (?P<iso>(?P<y1>\d{{4}})(?P<sep>[-/])(?P<m1>\d{{1,2}})(?P=sep)(?P<d1>\d{{1,2}}))
  | (?P<us>(?P<m2>\d{{1,2}})/(?P<d2>\d{{1,2}})/(?P<y2>\d{{4}}))
  | (?P<eu>(?P<d3>\d{{1,2}})-(?P<m3>\d{{1,2}})-(?P<y3>\d{{4}}))
  | (?P<day_first>(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?[ ]+)?(?P<d4>\d{{1,2}})[ ]+(?P<m4>{_MONTH})\.?,?[ ]+(?P<y4>\d{{4}}))
  | (?P<month_first>(?P<m5>{_MONTH})\.?[ ]+(?P<d5>\d{{1,2}}),?[ ]+(?P<y5>\d{{4}}))
"""
_CLOCK = r"""(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:[ ]*(?P<half>[ap]m)(?![a-z]))?"""
_ZONE = r"""[ ]*(?:(?P<off>[+-]\d{2}(?::?\d{2})?)|(?P<abbr>z|utc|gmt|est|edt|cet|cest)(?![a-z/])|(?P<region>[a-z][a-z_]+(?:/[a-z0-9_+-]+)+))(?:\[(?P<note>[a-z0-9_/+-]+)\])?"""
PATTERN = re.compile(
    rf"""(?:
    (?:{_DATES})(?:(?:[T]|[ ]+){_CLOCK})?(?:{_ZONE})?
  | (?P<compact>(?P<y6>\d{{4}})(?P<m6>\d{{2}})(?P<d6>\d{{2}})T(?P<h6>\d{{2}})(?P<mi6>\d{{2}})(?P<s6>\d{{2}})?(?:[.,](?P<f6>\d+))?(?:(?P<off6>[+-]\d{{2}}(?::?\d{{2}})?)|(?P<abbr6>z|utc|gmt))?)
  | (?P<bare>-?\d+)
    )""",
    re.IGNORECASE | re.VERBOSE | re.ASCII,
)
_AT = PATTERN.groupindex
_NUMBER_OF = {m: i + 1 for i, m in enumerate(MONTHS)} | {m: i + 1 for i, m in enumerate(FULL_MONTHS)}
#: Digits of a bare number: what one unit is in microseconds.
_BARE_UNIT = {9: 1_000_000, 10: 1_000_000, 12: 1000, 13: 1000, 15: 1, 16: 1}
_LOCAL, _INSTANT = 0, 1
_SPAN = 86_400


def days_from_civil(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of a Gregorian date, in integers."""
    shifted = year - (month <= 2)
    era = np.floor_divide(shifted, 400)
    of_era = shifted - era * 400
    of_year = (153 * (month + np.where(month > 2, -3, 9)) + 2) // 5 + day - 1
    return era * 146_097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719_468


def _month_length(year: np.ndarray, month: np.ndarray) -> np.ndarray:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[month - 1] + (leap & (month == 2))


@lru_cache(maxsize=1024)
def _zone(name: str) -> zoneinfo.ZoneInfo | None:
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _offset_at(zone: zoneinfo.ZoneInfo, epoch: int) -> int:
    import datetime as dt

    moment = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=epoch)
    return int(moment.astimezone(zone).utcoffset().total_seconds())


@lru_cache(maxsize=4096)
def _transitions(name: str, year: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Instants within the year (and a few days around) at which the offset changes; offsets before, between and after."""
    zone = _zone(name)
    lo = int(days_from_civil(np.int64(year), np.int64(1), np.int64(1))) * _SPAN - 4 * _SPAN
    hi = lo + 374 * _SPAN
    lo, hi = max(lo, -62_135_000_000), min(hi, 253_402_000_000)
    at, offsets = [], [_offset_at(zone, lo)]
    left = lo
    while left < hi:
        right = min(left + 4 * _SPAN, hi)
        if (new := _offset_at(zone, right)) != offsets[-1]:
            a, b = left, right
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (a, mid) if _offset_at(zone, mid) != offsets[-1] else (mid, b)
            at.append(b)
            offsets.append(new)
        left = right
    return tuple(at), tuple(offsets)


def local_to_utc(local: np.ndarray, name: str, years: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of local seconds in a zone, and whether each local time occurs exactly once."""
    out, once = np.zeros(len(local), np.int64), np.zeros(len(local), bool)
    if _zone(name) is None:
        return out, once
    for year in np.unique(years):
        rows = np.flatnonzero(years == year)
        at, offsets = (np.array(x, np.int64) for x in _transitions(name, int(year)))
        t, hits = local[rows], np.zeros(len(rows), np.int64)
        for offset in np.unique(offsets):
            utc = t - offset
            real = offsets[np.searchsorted(at, utc, "right")] == offset
            hits += real
            out[rows[real]] = utc[real]
        once[rows] = hits == 1
    return out, once


def _offset_seconds(text: str) -> int | None:
    digits = text[1:].replace(":", "")
    hours, minutes = int(digits[:2]), int(digits[2:] or 0)
    if hours > 18 or minutes > 59:
        return None
    return (hours * 3600 + minutes * 60) * (-1 if text[0] == "-" else 1)


def _components(text: str) -> tuple | None:
    """(y, m, d, h, mi, s, us, offset seconds or None, zone name or None), or (None, us) for a bare number."""
    match = PATTERN.fullmatch(text)
    if not match:
        return None
    g = match.group
    kind = next(k for k in ("iso", "us", "eu", "day_first", "month_first", "compact", "bare") if g(k) is not None)
    if kind == "bare":
        unit = _BARE_UNIT.get(len(text.lstrip("-")))
        return None if unit is None else (None, int(text) * unit)
    n = str(("iso", "us", "eu", "day_first", "month_first", "compact").index(kind) + 1)
    month = g("m" + n)
    month = int(month) if month[0].isdigit() else _NUMBER_OF[month.lower()]
    tail = "6" if n == "6" else ""
    hour, minute, second, part = g("h" + tail), g("mi" + tail), g("s" + tail), g("f" + tail)
    hour = int(hour) if hour else 0
    if not tail and (half := g("half")):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half.lower() == "pm" else 0)
    offset = region = None
    if sign := g("off" + tail):
        if (offset := _offset_seconds(sign)) is None:
            return None
    elif letters := g("abbr" + tail):
        offset = ZONE_HOURS[letters.upper()] * 3600
    elif not tail:
        region = g("region")
    return int(g("y" + n)), month, int(g("d" + n)), hour, int(minute or 0), int(second or 0), int((part or "0")[:6].ljust(6, "0")), offset, region


def normalise_column(texts: list[str | None], zones: list[str | None]) -> np.ndarray:
    """UTC microseconds of each text as float-free objects: an int64 array with a parallel mask (masked = no instant)."""
    count = len(texts)
    result, known = np.zeros(count, np.int64), np.zeros(count, bool)
    rows, parts, fixed, named = [], [], [], []
    for i, text in enumerate(texts):
        if text is None or not (text := text.strip()) or (found := _components(text)) is None:
            continue
        if found[0] is None:
            result[i], known[i] = found[1], True
            continue
        rows.append(i)
        parts.append(found[:7])
        fixed.append(found[7])
        named.append(found[8] or zones[i])
    if rows:
        at = np.array(rows)
        y, m, d, h, mi, s, us = np.array(parts, np.int64).T
        fits = (y >= 1) & (y <= 9998) & (m >= 1) & (m <= 12) & (d >= 1) & (h <= 23) & (mi <= 59) & (s <= 59)
        m = np.where(fits, m, 1)
        fits &= d <= _month_length(y, m)
        seconds = days_from_civil(y, m, d) * _SPAN + h * 3600 + mi * 60 + s
        has_offset = np.array([o is not None for o in fixed])
        utc = seconds - np.array([o or 0 for o in fixed], np.int64)
        settled = fits & has_offset
        by_zone: dict[str, list[int]] = {}
        for j in np.flatnonzero(fits & ~has_offset):
            if named[j]:
                by_zone.setdefault(named[j], []).append(j)
        for zone, members in by_zone.items():
            members = np.array(members)
            utc[members], settled[members] = local_to_utc(seconds[members], zone, y[members])
        result[at] = utc * 1_000_000 + us
        known[at] = settled
    return np.ma.masked_array(result, ~known)


def normalise_timestamps(df: DataFrame, text: str, zone: str, output: str = "epoch_us") -> DataFrame:
    """``df`` with ``output``: microseconds since 1970 UTC of the one instant that ``text`` denotes, else null.

    A value with no zone or offset is local time in the IANA zone of column ``zone`` (null or unknown:
    no instant). A date alone means 00:00. With the year last, slashes mean month first and hyphens
    day first. Bare numbers are seconds, milliseconds or microseconds by their length. Digits beyond
    microseconds are cut off. Null, empty, invalid and out-of-range values and local times that occur
    twice or never give null. An input column named like ``output`` is replaced.
    """
    kept = [f for f in df.schema.fields if f.name != output]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(output, T.LongType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = normalise_column(batch.column(names.index(text)).to_pylist(), batch.column(names.index(zone)).to_pylist())
            column = pa.array(found.data, pa.int64(), mask=np.ma.getmaskarray(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=schema.names)

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(convert, schema)
