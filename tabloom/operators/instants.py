"""Mixed timestamp formats and zones, normalised to one unambiguous form.

Every written form is one branch of a single compiled alternation; branches
share group names, so a match hands over year, month, day, clock and zone at
once, whatever form it was. Calendar ranges are checked on the integers, and an
instant is assembled as ``days * 86400 + seconds - offset`` (days from the
civil calendar by integer arithmetic).

Defined results: null, blank, placeholder, impossible date, wall times that
occur twice or never in their zone, unknown zones, offsets beyond 14 hours and
bare numbers of columns without corroboration give ok = false with a reason.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import map_batches

#: Ranges of bare numbers that denote days: years in four digits, spreadsheet serials in five.
YEAR_RANGE = (1850, 2100)
SERIAL_MAX = 80000
#: Share of a column's bare numbers that must be of one kind.
CORROBORATION = 0.95
#: Two-digit years from here on are 19xx.
CENTURY_PIVOT = 30
#: Largest distance from UTC, in seconds.
MAX_OFFSET = 14 * 3600

# Zone abbreviations with one meaning, in hours.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "EST": -5, "EDT": -4, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

# Month names, English by their first three letters, Ukrainian by their stems.
MONTHS_EN = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTHS_UK = ("січ", "лют", "берез", "квіт", "трав", "черв", "лип", "серп", "верес", "жовт", "листоп", "груд")

_EN = r"(?P<en>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_UK = "(?P<uk>" + "|".join(f"{stem}[а-яіїє]*" for stem in MONTHS_UK) + ")"
_CLOCK = r"(?P<hh>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<ss>[0-9]{2})(?:[.,][0-9]+)?)?(?:\ ?(?P<half>[ap]\.?m\.?))?"
_ZONE = (
    r"(?:\ ?(?P<off>z|[+\-][0-9]{2}(?::?[0-9]{2})?)(?:\[[a-z0-9_+\-/]+\])?|\ ?\[(?P<iana>[a-z0-9_+\-/]+)\]|\ (?P<abbr>[a-z]{2,5}))"
)
_TAIL = rf"(?:(?:T|,?\ +){_CLOCK}{_ZONE}?)?"
#: One alternation for every form; the group names are shared by its branches.
FORMS = regex.compile(
    "|".join(
        (
            r"(?P<bare>[0-9]+)",
            rf"(?P<y>[0-9]{{4}})(?P<sep>[\-./])(?P<m>[0-9]{{1,2}})(?P=sep)(?P<d>[0-9]{{1,2}}){_TAIL}",
            rf"(?P<a>[0-9]{{1,2}})(?P<sep>[./\-])(?P<b>[0-9]{{1,2}})(?P=sep)(?P<y>[0-9]{{4}}|[0-9]{{2}}){_TAIL}",
            rf"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\ +)?(?P<d>[0-9]{{1,2}})[\ \-]+{_EN}[\ \-]+(?P<y>[0-9]{{4}}){_TAIL}",
            rf"{_EN}\ +(?P<d>[0-9]{{1,2}}),?\ +(?P<y>[0-9]{{4}}){_TAIL}",
            rf"(?P<d>[0-9]{{1,2}})\ +{_UK}\ +(?P<y>[0-9]{{4}})(?:\ *(?:р\.|року|р))?{_TAIL}",
        )
    ),
    regex.IGNORECASE | regex.V1,
)

_MONTH_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    y -= m <= 2
    era, yoe = divmod(y, 400)
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def civil_from_days(days: int) -> tuple[int, int, int]:
    """The date of a day number; the inverse of ``days_from_civil``."""
    era, doe = divmod(days + 719468, 146097)
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    m = mp + (3 if mp < 10 else -9)
    return yoe + era * 400 + (m <= 2), m, doy - (153 * mp + 2) // 5 + 1


def real_day(y: int, m: int, d: int) -> bool:
    if not (1 <= m <= 12 and 1 <= d <= _MONTH_DAYS[m - 1] and 1 <= y <= 9999):
        return False
    return m != 2 or d < 29 or (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0))


@lru_cache(maxsize=None)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, OSError, ValueError):
        return None


@lru_cache(maxsize=65536)
def wall_offset(name: str, y: int, m: int, d: int, hh: int, mi: int) -> int | None:
    """Seconds east of UTC of a wall time; None if it occurs twice or never, or the zone is unknown."""
    zone = _zone(name)
    if zone is None:
        return None
    first = dt.datetime(y, m, d, hh, mi, tzinfo=zone)
    early, late = first.utcoffset(), first.replace(fold=1).utcoffset()
    return int(early.total_seconds()) if early == late else None


def _instant(seconds: int) -> str | None:
    days, rest = divmod(seconds, 86400)
    y, m, d = civil_from_days(days)
    if not 1 <= y <= 9999:
        return None
    return f"{y:04d}-{m:02d}-{d:02d}T{rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}Z"


def _bare(text: str, days_kind: bool, unix_kind: bool) -> tuple[str | None, str | None]:
    n = len(text)
    if days_kind and n == 4 and YEAR_RANGE[0] <= int(text) <= YEAR_RANGE[1]:
        return text, None
    if days_kind and n == 5 and 1 <= int(text) <= SERIAL_MAX:
        return "%04d-%02d-%02d" % civil_from_days(int(text) - 25569), None
    if unix_kind and n in (10, 13):
        return _instant(int(text) // (1000 if n == 13 else 1)), None
    return None, "bare number without corroboration" if not (days_kind or unix_kind) else "bare number outside its column's kind"


def canonical_instant(
    text: str | None, zone: str | None = None, days_kind: bool = False, unix_kind: bool = False
) -> tuple[str | None, str | None]:
    """(value, None) or (None, reason) of one cell."""
    text = (text or "").strip()
    if not text:
        return None, "empty"
    m = FORMS.fullmatch(text)
    if m is None:
        return None, "no form"
    g = m.groupdict()
    if g["bare"]:
        return _bare(text, days_kind, unix_kind)
    y = int(g["y"])
    if len(g["y"]) == 2:
        y += 1900 if y >= CENTURY_PIVOT else 2000
    if g["a"]:
        d, mo = int(g["a"]), int(g["b"])
        if mo > 12 >= d:
            d, mo = mo, d
    else:
        d = int(g["d"])
        if g["en"]:
            mo = MONTHS_EN.index(g["en"][:3].lower()) + 1
        elif g["uk"]:
            name = g["uk"].lower()
            mo = next(k for k, stem in enumerate(MONTHS_UK, 1) if name.startswith(stem))
        else:
            mo = int(g["m"])
    if not real_day(y, mo, d):
        return None, "impossible date"
    if g["hh"] is None:
        return f"{y:04d}-{mo:02d}-{d:02d}", None
    hh, mi, ss = int(g["hh"]), int(g["mi"]), int(g["ss"] or 0)
    if g["half"]:
        if not 1 <= hh <= 12:
            return None, "impossible time"
        hh = hh % 12 + (12 if g["half"][0] in "pP" else 0)
    if hh > 23 or mi > 59 or ss > 59:
        return None, "impossible time"
    if g["off"]:
        off = g["off"]
        if off in "zZ":
            east = 0
        else:
            digits = off[1:].replace(":", "")
            minutes = int(digits[2:] or 0)
            east = int(digits[:2]) * 3600 + minutes * 60
            if east > MAX_OFFSET or minutes > 59:
                return None, "offset out of range"
            east = -east if off[0] == "-" else east
    elif g["abbr"]:
        hours = ABBREVIATIONS.get(g["abbr"].upper())
        if hours is None:
            return None, "unknown zone"
        east = hours * 3600
    else:
        where = g["iana"] or zone
        if not where or _zone(where) is None:
            return None, "unknown zone"
        east = wall_offset(where, y, mo, d, hh, mi)
        if east is None:
            return None, "wall time occurs twice or never"
    value = _instant(days_from_civil(y, mo, d) * 86400 + hh * 3600 + mi * 60 + ss - east)
    return value, None if value else "out of range"


def numeric_kinds(cells: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per column: may its bare numbers be read as days, or as Unix time? (ColumnEvidence.numeric_dates)

    One aggregate with map-side combine; its result has a row per column.
    """
    text = F.regexp_replace(F.col(value), r"(?U)^\s+|\s+$", "")
    bare = text.rlike(r"^[0-9]+$")
    n = F.length(text)
    number = F.when(n.isin(4, 5), text.cast("int"))
    days = bare & ((n == 4) & number.between(*YEAR_RANGE) | (n == 5) & number.between(1, SERIAL_MAX))
    unix = bare & n.isin(10, 13)
    total = F.count(F.when(bare, 1))
    share = lambda kind: F.coalesce(F.count(F.when(kind, 1)) >= F.lit(CORROBORATION) * total, F.lit(False)) & (total > 0)
    return cells.groupBy(*by).agg(share(days).alias("days_kind"), share(unix).alias("unix_kind"))


def canonical_instants(
    cells: DataFrame, value: str, zone: Column, days_kind: Column, unix_kind: Column, keep: list[str]
) -> DataFrame:
    """``keep`` with canon_ok, canon_value and canon_reason of each cell; a narrow map over Arrow batches."""
    source = cells.select(
        *keep,
        F.col(value).alias("__value"),
        zone.alias("__zone"),
        F.coalesce(days_kind, F.lit(False)).alias("__days"),
        F.coalesce(unix_kind, F.lit(False)).alias("__unix"),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keep).schema)
    schema += ", canon_ok boolean, canon_value string, canon_reason string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [canonical_instant(*x) for x in zip(pdf["__value"], pdf["__zone"], pdf["__days"], pdf["__unix"], strict=True)]
            out = pdf[keep].copy()
            out["canon_ok"] = [v is not None for v, _ in got]
            out["canon_value"] = [v for v, _ in got]
            out["canon_reason"] = [r for _, r in got]
            yield out

    return map_batches(source, run, schema)
