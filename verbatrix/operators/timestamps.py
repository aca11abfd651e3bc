"""Mixed timestamp forms and time zones to one UTC form.

A value is reduced to the mask of its character classes (digits 9, letters a, runs of letters one a, white space one
blank). Each distinct mask is resolved to its parsers over all its values, so that a value's moment depends on the value
alone; the values of a parser are then taken apart and converted together in numpy. Local times go through transition tables, built once per zone from the installed IANA release and
stamped with its version: one searchsorted per zone and batch.

Rules: a local time that occurs twice is the earlier, one that is skipped moves on by the gap, fractions are cut off,
missing seconds are 00, a date alone is its local midnight, two-digit years are 20xx, bare numbers of 10 or 13 digits are
seconds or milliseconds since 1970. A stated offset or abbreviation holds as written; a general zone name (ET, CT) is
local time. Slashed dates are month first in zones that start with America; else day first, unless only month first is
a date.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by language, English abbreviations by their first three letters.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "abbreviated": "jan feb mar apr may jun jul aug sep oct nov dec",
}
MONTH = {name: i for names in MONTHS.values() for i, name in enumerate(names.split(), 1)} | {"sept": 9, "setiembre": 9, "jänner": 1}

# Minutes east of UTC of zone abbreviations.
ABBREVIATION = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
#: General zone names: they name no offset, so the value is local time.
GENERAL = {"et", "ct", "mt", "pt", "at", "local"}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,]\d+)?)?"
_HALF = r"(?: ?(?P<half>[AaPp]\.?[Mm]\.?))?"
_ZONE = r"(?: ?(?P<zone>(?:UTC|GMT)?[+\-−]\d\d?:?(?:\d\d)?|[A-Za-z]{1,5}))?(?:\[(?P<named>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)\])?"
_WORD = r"[^\W\d_]+"
_DAY = rf"(?:{_WORD}\.?,? )?"
#: Parsers in the order they are tried on the values of a mask.
PARSERS = [
    re.compile(x)
    for x in (
        rf"(?P<y>\d{{4}})-(?P<m>\d\d?)-(?P<d>\d\d?)(?:[Tt ,]+{_TIME}{_HALF}{_ZONE})?",
        rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)[Tt](?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?{_ZONE}",
        r"(?P<seconds>\d{10})",
        r"(?P<seconds>\d{10})\d{3}",
        rf"{_DAY}(?P<d>\d\d?)(?:st|nd|rd|th|\.)?[ \-](?:de )?(?P<month>{_WORD})\.?[ \-,](?:de )?(?P<y>\d{{4}}|\d\d)(?:,? (?:at |um |à )?{_TIME}(?: Uhr| h)?{_HALF}{_ZONE})?",
        rf"{_DAY}(?P<month>{_WORD})\.? (?P<d>\d\d?)(?:st|nd|rd|th)? {_TIME}{_ZONE} (?P<y>\d{{4}})",
        rf"{_DAY}(?P<month>{_WORD})\.? (?P<d>\d\d?)(?:st|nd|rd|th)?,? (?P<y>\d{{4}})(?:,?(?: at)? {_TIME}{_HALF}{_ZONE})?",
        rf"(?P<y>\d{{4}})[/.](?P<m>\d\d?)[/.](?P<d>\d\d?)(?:,? {_TIME}{_HALF}{_ZONE})?",
        rf"(?P<a>\d\d?)/(?P<b>\d\d?)/(?P<y>\d{{4}}|\d\d)(?:,? {_TIME}{_HALF}{_ZONE})?",
        rf"(?P<d>\d\d?)\.(?P<m>\d\d?)\.(?P<y>\d{{4}}|\d\d)(?:,? {_TIME}{_HALF}{_ZONE})?",
        r"(?P<y>\d{4})年(?P<m>\d\d?)月(?P<d>\d\d?)日(?: ?(?P<h>\d\d?)[時时:](?P<mi>\d\d?)分?(?:(?P<s>\d\d?)秒)?)?",
    )
]


@dataclass(frozen=True)
class ZoneTable:
    """UTC offsets of one zone: offsets[i] holds for local times before bounds[i], offsets[-1] after the last bound."""

    name: str
    version: str
    bounds: np.ndarray
    offsets: np.ndarray

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        """Seconds of local wall clock to UTC seconds; the earlier of two, on by the gap if skipped."""
        return local - self.offsets[np.searchsorted(self.bounds, local, side="right")]


def tz_version() -> str:
    """The IANA release of the zone data in use, or 'system'."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except (ImportError, AttributeError):
        pass
    try:
        with open("/usr/share/zoneinfo/tzdata.zi") as f:
            return f.readline().split()[-1]
    except OSError:
        return "system"


@lru_cache(maxsize=1024)
def zone_table(name: str, first: int = 1900, last: int = 2100) -> ZoneTable | None:
    """The transition table of an IANA zone over the years first..last; None if there is no such zone."""
    try:
        zone = ZoneInfo(name)
    except Exception:
        return None

    def offset(t: int) -> int:
        return round(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())

    begin, end, day = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (first, last, 1970))
    day = 3 * 86400
    bounds, offsets = [], [offset(begin)]
    for t in range(begin + day, end, day):
        if (now := offset(t)) != offsets[-1]:
            low, high = t - day, t
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if offset(mid) != offsets[-1] else (mid, high)
            now = offset(high)
            bounds.append(high + max(offsets[-1], now))
            offsets.append(now)
    return ZoneTable(name, tz_version(), np.array(bounds, dtype="int64"), np.array(offsets, dtype="int64"))


class _Classes(dict):
    """Character to class, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c
        return out


_CLASSES = _Classes()
_RUNS = re.compile(r"a+| +")


def shape_mask(value: str) -> str:
    """The character-class mask of a value: '2024-08-24T08:07:44Z' gives '9999-99-99a99:99:99a'."""
    return _RUNS.sub(lambda m: m[0][0], value.translate(_CLASSES).strip())


def _readings(values: pd.Series) -> Iterator[tuple[re.Pattern, pd.Series]]:
    """Parsers with the values of one mask that each reads: words may differ below a mask, so every value has the first parser that takes it."""
    for p in PARSERS:
        taken = np.fromiter((p.fullmatch(v) is not None for v in values), bool, len(values))
        if taken.any():
            yield p, values[taken]
            values = values[~taken]
        if values.empty:
            return


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of Gregorian dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _month_days(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))


def _stated_offset(zone: str) -> float:
    """Seconds east of UTC that a zone text states; NaN for a general name, inf for one that means nothing here."""
    z = zone.lower().replace("−", "-")
    if z in GENERAL:
        return np.nan
    if z in ABBREVIATION:
        return ABBREVIATION[z] * 60.0
    if m := re.fullmatch(r"(?:utc|gmt)?([+-])(\d\d?):?(\d\d)?", z):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours <= 18 and minutes < 60:
            return (hours * 3600 + minutes * 60) * (-1.0 if m[1] == "-" else 1.0)
    return np.inf


def parse_moments(values: pd.Series, zones: pd.Series) -> pd.Series:
    """UTC seconds since 1970 of each value, read in its zone where the value names none; <NA> where it is no moment."""
    out = pd.Series(pd.NA, index=values.index, dtype="Int64")
    clean = values.dropna().str.split().str.join(" ")
    masks = clean.map(shape_mask)
    for p, group in (x for _, same in clean.groupby(masks, sort=False) for x in _readings(same)):
        parts = group.str.extract(f"^{p.pattern}$")
        parts = parts[parts.notna().any(axis=1)]
        if parts.empty:
            continue
        if "seconds" in parts:
            out[parts.index] = parts["seconds"].astype("int64")
            continue

        def number(name: str, default: int = 0) -> np.ndarray:
            return pd.to_numeric(parts[name]).fillna(default).to_numpy("int64") if name in parts else np.full(len(parts), default)

        y, d, h, mi, s = number("y"), number("d"), number("h"), number("mi"), number("s")
        y = np.where(parts["y"].str.len() == 2, 2000 + y, y)
        local = zones.reindex(parts.index)
        if "month" in parts:
            m = parts["month"].str.lower().map(MONTH).fillna(0).to_numpy("int64")
        elif "a" in parts:
            a, b = number("a"), number("b")
            month_first = local.str.startswith("America").fillna(False).to_numpy(bool) | ((b > 12) & (a <= 12) & ~local.str.startswith("Europe").fillna(False).to_numpy(bool))
            m, d = np.where(month_first, a, b), np.where(month_first, b, a)
        else:
            m = number("m")
        good = (m >= 1) & (m <= 12) & (d >= 1) & (d <= _month_days(y, m)) & (h < 24) & (mi < 60) & (s < 60)
        if "half" in parts:
            half = parts["half"].str.lower().str[:1]
            has = half.notna().to_numpy()
            good &= ~has | ((h >= 1) & (h <= 12))
            h = np.where(has, h % 12 + np.where((half == "p").to_numpy(), 12, 0), h)
        wall = _days(y, m, d) * 86400 + h * 3600 + mi * 60 + s
        stated = np.full(len(parts), np.nan)
        if "zone" in parts:
            texts = parts["zone"]
            stated = texts.map({z: _stated_offset(z) for z in texts.dropna().unique()}).to_numpy("float64")
        if "named" in parts:
            local = parts["named"].where(parts["named"].notna(), local)
        good &= ~np.isinf(stated)
        utc = wall - np.nan_to_num(stated, posinf=0.0).astype("int64")
        unstated = np.isnan(stated)
        for name in local[unstated].dropna().unique():
            at = unstated & (local == name).to_numpy()
            if (table := zone_table(name)) is None:
                good &= ~at
            else:
                utc[at] = table.to_utc(wall[at])
        good &= ~(unstated & local.isna().to_numpy())
        out[parts.index[good]] = utc[good]
    return out


def utc_moments(df: DataFrame, value: str = "value", zone: str = "zone") -> DataFrame:
    """df with a column `utc` (YYYY-MM-DDTHH:MM:SSZ), without the rows whose value names no moment.

    zone is an IANA name for values that state none. Nulls, blank and unreadable values, dates that don't exist and local
    times without a zone give no row; repeated rows stay; a column already called utc is replaced.
    """
    keep = [c for c in df.columns if c != "utc"]
    schema = df.select(*keep).schema.add("__s", "long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["__s"] = parse_moments(f[value], f[zone])
            yield f[f["__s"].notna()]

    found = df.select(*keep).filter(F.length(F.trim(F.col(value))) > 0).mapInPandas(run, schema)
    return found.withColumn("utc", utc_text(F.col("__s"))).drop("__s")


def utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as YYYY-MM-DDTHH:MM:SSZ, whatever the session's time zone."""
    civil = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.date_format(civil, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def header_values(pages: DataFrame, names: list[str], id_col: str = "page_id", headers_col: str = "headers") -> DataFrame:
    """(id, field, value) of the headers whose name, in any case, is in names; field is the lower-case name."""
    rows = pages.select(id_col, F.explode(headers_col).alias("k", "value"))
    return rows.select(id_col, F.lower(F.trim("k")).alias("field"), "value").filter(F.col("field").isin(*names))
