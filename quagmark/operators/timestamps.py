"""Text stamps of mixed notation, precision and zone -> one UTC instant, or none where the text is undecidable.

Every text is turned into an array of its valid interpretations (notation, day-month order, zone, side of a clock change).
A Viterbi pass over each source's records then chooses one per record: an interpretation against the source's reading
convention costs most, a change of notation and a step back in time cost a little. A pass back gives the margin of the
choice, which is how much dearer the cheapest path through any other instant of the record is. A record is decided if its
margin is large enough: at ``CONVENTION_MARGIN`` only the conventions can decide, at ``ORDER_MARGIN`` the record order may too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from calendar import monthrange
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US, MINUTE_US = 86_400_000_000, 60_000_000
FIRST_YEAR, LAST_YEAR = 2018, 2026

# Offsets in minutes of the usual abbreviations, by the part of the world of the place's zone.
ABBREVIATIONS = {
    "Europe": {"WET": 0, "WEST": 60, "GMT": 0, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180},
    "Atlantic": {"WET": 0, "WEST": 60, "GMT": 0, "AST": -240, "ADT": -180},
    "America": {"NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600},
    "Australia": {"AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "EST": 600, "EDT": 660, "CST": 570, "CDT": 630, "WST": 480},
    "Asia": {"JST": 540, "KST": 540, "NPT": 345, "IST": 330, "PKT": 300, "HKT": 480, "SGT": 480, "CST": 480, "WIB": 420},
    "Pacific": {"NZST": 720, "NZDT": 780, "HST": -600, "SST": -660, "CHST": 600},
    "Africa": {"WAT": 60, "CAT": 120, "SAST": 120, "EAT": 180, "EET": 120},
}
MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
MONTH_NAMES = "january february march april may june july august september october november december".split()
WEEKDAYS = "mon tue wed thu fri sat sun".split()
WEEKDAY_NAMES = "monday tuesday wednesday thursday friday saturday sunday".split()

_ZONE = r"(?P<zone>[Zz]|[+\-−]\d{2}(?::?\d{2})?|(?:UTC|GMT|utc|gmt)(?:[+\-−]\d{1,2}(?::?\d{2})?)?|[A-Z][A-Za-z_]+(?:/[A-Za-z_+\-]+){1,2}|[A-Z]{2,5})"
_BRACKET = r"(?:\s*[\[(][A-Za-z_/+\-]+[\])])?"
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2}))?(?:[.,](?P<f>\d+))?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_BARE_12H = r"(?P<h>\d{1,2})\s*(?P<ap>[AaPp])\.?[Mm]\.?"
_COMPACT = r"(?P<h>\d{2})(?:(?P<mi>\d{2})(?P<s>\d{2})?)?(?:[.,](?P<f>\d+))?"
_TAIL = rf"(?:\s*{_ZONE}{_BRACKET})?$"
_WDAY = r"(?:(?P<wd>[A-Za-z]{3,9})\.?,?\s+)?"
_NAME = r"(?P<mon>[A-Za-z]{3,9})\.?"
_ORD = r"(?:st|nd|rd|th)?"

#: notation -> (pattern, how the date is given)
NOTATIONS: list[tuple[str, re.Pattern[str], str]] = [
    ("iso_extended", re.compile(rf"^(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})(?:[Tt]|\s+){_CLOCK}{_TAIL}"), "ymd"),
    ("iso_hour", re.compile(rf"^(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})[Tt](?P<h>\d{{2}})(?:[.,](?P<f>\d+))?{_TAIL}"), "ymd"),
    ("iso_basic", re.compile(rf"^(?P<y>\d{{4}})-?(?P<m>\d{{2}})-?(?P<d>\d{{2}})[Tt\s]{_COMPACT}{_TAIL}"), "ymd"),
    ("basic_date", re.compile(rf"^(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[Tt]|\s+){_CLOCK}{_TAIL}"), "ymd"),
    ("iso_ordinal", re.compile(rf"^(?P<y>\d{{4}})-?(?P<doy>\d{{3}})(?:[Tt]|\s+){_CLOCK}{_TAIL}"), "ordinal"),
    ("iso_ordinal_basic", re.compile(rf"^(?P<y>\d{{4}})-?(?P<doy>\d{{3}})[Tt]{_COMPACT}{_TAIL}"), "ordinal"),
    ("iso_week", re.compile(rf"^(?P<y>\d{{4}})-?[Ww](?P<w>\d{{2}})-?(?P<wday>[1-7])(?:[Tt]|\s+){_CLOCK}{_TAIL}"), "week"),
    ("iso_week_basic", re.compile(rf"^(?P<y>\d{{4}})-?[Ww](?P<w>\d{{2}})-?(?P<wday>[1-7])[Tt]{_COMPACT}{_TAIL}"), "week"),
    ("year_first", re.compile(rf"^(?P<y>\d{{4}})(?P<sep>[/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:[Tt]|,?\s+){_CLOCK}{_TAIL}"), "ymd"),
    ("digits", re.compile(r"^(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?P<h>\d{2})(?:(?P<mi>\d{2})(?P<s>\d{2})?)?(?:[.,](?P<f>\d+))?(?:\s*(?P<zone>[Zz]|[+\-−]\d{2}:?\d{2}))?$"), "ymd"),
    ("epoch_s", re.compile(r"^(?P<epoch>\d{10})$"), "epoch"),
    ("epoch_ms", re.compile(r"^(?P<epoch>\d{13})$"), "epoch"),
    ("numeric", re.compile(rf"^(?P<a>\d{{1,2}})(?P<sep>[./\-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}})(?:[Tt]|,?\s+)(?:{_CLOCK}){_TAIL}"), "numeric"),
    ("numeric_12h", re.compile(rf"^(?P<a>\d{{1,2}})(?P<sep>[./\-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}),?\s+{_BARE_12H}{_TAIL}"), "numeric"),
    ("day_month", re.compile(rf"^{_WDAY}(?P<d>\d{{1,2}}){_ORD}[\-\s.]+{_NAME}[\-\s.,]+(?P<y>\d{{4}})(?:[Tt]|,?\s+){_CLOCK}{_TAIL}"), "named"),
    ("month_day", re.compile(rf"^{_WDAY}{_NAME}[\s\-]+(?P<d>\d{{1,2}}){_ORD},?[\s\-]+(?P<y>\d{{4}})(?:[Tt]|,?\s+){_CLOCK}{_TAIL}"), "named"),
    ("year_month_name", re.compile(rf"^(?P<y>\d{{4}})[\-\s/]+{_NAME}[\-\s/]+(?P<d>\d{{1,2}})(?:[Tt]|,?\s+){_CLOCK}{_TAIL}"), "named"),
    ("time", re.compile(rf"^[Tt]?{_CLOCK}{_TAIL}"), "time"),
    ("time_12h", re.compile(rf"^{_BARE_12H}{_TAIL}"), "time"),
    ("time_hour", re.compile(r"^[Tt](?P<h>\d{2})(?:[.,](?P<f>\d+))?(?:\s*(?P<zone>[Zz]|[+\-−]\d{2}(?::?\d{2})?))?$"), "time"),
    # four digits and two are a year and its month where they can be, hence no time of day with an offset
    ("time_basic", re.compile(r"^(?!(?:19|20)\d\d-(?:0[1-9]|1[0-2])$)[Tt]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?(?:\s*(?P<zone>[Zz]|[+\-−]\d{2}(?::?\d{2})?))?$"), "time"),
]
_ISO = {"iso_extended", "iso_hour", "iso_basic", "basic_date", "iso_ordinal", "iso_ordinal_basic", "iso_week", "iso_week_basic", "digits", "year_first", "time", "time_basic", "time_hour"}

#: Costs of the Viterbi pass.
AGAINST_CONVENTION, NOTATION_SWITCH, BACK_IN_TIME = 1000.0, 1.0, 2.0
#: Margins from which a record is decided. A record's place in the order can cost at most two switches and two steps back.
CONVENTION_MARGIN, ORDER_MARGIN = AGAINST_CONVENTION / 2, BACK_IN_TIME


@lru_cache(maxsize=None)
def zone_table(name: str) -> tuple[list[int], list[int]] | None:
    """Changes of offset of a zone: their UTC microseconds and the offset in minutes from each on; None if there is no such zone."""
    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None

    def offset(t: datetime) -> int:
        return int(t.astimezone(zone).utcoffset().total_seconds() // 60)

    t, end = datetime(FIRST_YEAR - 1, 1, 1, tzinfo=UTC), datetime(LAST_YEAR + 2, 1, 1, tzinfo=UTC)
    at, offsets = [-(1 << 62)], [offset(t)]
    while t < end:
        later = t + timedelta(days=1)
        if offset(later) != offsets[-1]:
            low, high = t, later
            while high - low > timedelta(minutes=1):
                middle = (low + (high - low) / 2).replace(second=0, microsecond=0)
                low, high = (middle, high) if offset(middle) == offsets[-1] else (low, middle)
            at.append(_micros(high))
            offsets.append(offset(high))
        t = later
    return at, offsets


@lru_cache(maxsize=None)
def zone_names(name: str) -> dict[str, int]:
    """Abbreviations that a place's own zone uses, with their offsets in minutes; the ones that it uses with two offsets are left out."""
    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return {}
    found: dict[str, set[int]] = {}
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        for month in range(1, 13):
            t = datetime(year, month, 15, tzinfo=UTC).astimezone(zone)
            found.setdefault(t.tzname(), set()).add(int(t.utcoffset().total_seconds() // 60))
    return {k: v.pop() for k, v in found.items() if len(v) == 1 and k.isalpha()}


def _micros(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1))


def local_to_utc(local_us: int, zone: str) -> list[int]:
    """Every UTC instant at which the zone's clock shows this time: none where it was skipped, two where it was shown twice."""
    table = zone_table(zone)
    if table is None:
        return []
    at, offsets = table
    k = bisect_right(at, local_us)
    near = offsets[max(0, k - 2) : k + 2]
    return sorted({u for o in set(near) if offsets[bisect_right(at, u := local_us - o * MINUTE_US) - 1] == o})


def _offset_minutes(text: str) -> int | None:
    sign = -1 if text[0] in "-−" else 1
    digits = text[1:].replace(":", "")
    h, m = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
    return sign * (60 * h + m) if h <= 18 and m < 60 else None


@lru_cache(maxsize=4096)
def _zone(text: str, place: str | None) -> tuple[str, int | str] | None:
    """('offset', minutes) or ('zone', name); None for a zone that nobody can place."""
    if text in ("Z", "z"):
        return "offset", 0
    if text[0] in "+-−":
        o = _offset_minutes(text)
        return None if o is None else ("offset", o)
    upper = text.upper()
    if upper[:3] in ("UTC", "GMT") and "/" not in text:
        if len(upper) == 3:
            return "offset", 0
        o = _offset_minutes(upper[3:]) if upper[3] in "+-−" else None
        return None if o is None else ("offset", o)
    if "/" in text:
        return ("zone", text) if zone_table(text) else None
    if place:
        own = zone_names(place)
        if upper in own:
            return "offset", own[upper]
        by_place = ABBREVIATIONS.get(place.split("/")[0], {})
        if upper in by_place:
            return "offset", by_place[upper]
        return None
    meant = {x[upper] for x in ABBREVIATIONS.values() if upper in x}
    return ("offset", meant.pop()) if len(meant) == 1 else None


def _month(name: str) -> int | None:
    low = name.lower()
    if low == "sept":
        return 9
    k = MONTHS.get(low[:3])
    return k if k and low in (MONTH_NAMES[k - 1], low[:3]) else None


@lru_cache(maxsize=65536)
def _day(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01, or None for an impossible date."""
    if not (FIRST_YEAR - 1 <= y <= LAST_YEAR + 1 and 1 <= m <= 12 and 1 <= d <= monthrange(y, m)[1]):
        return None
    return date(y, m, d).toordinal() - 719163


def _whole(digits: str) -> int:
    """A whole number of any length (``int`` refuses more than some thousand digits)."""
    n = 0
    for k in range(0, len(digits), 1000):
        n = n * 10 ** len(digits[k : k + 1000]) + int(digits[k : k + 1000])
    return n


def _clock(g: dict[str, str | None], iso: bool) -> int | None:
    """Microseconds since midnight; None for an impossible time. A fraction belongs to the last part that is given."""
    h, mi, s = int(g["h"]), int(g.get("mi") or 0), int(g.get("s") or 0)
    fraction = g.get("f")
    if ap := g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if ap in "pP" else 0)
    if mi > 59 or s > 59:
        return None
    part = 0
    if fraction:
        unit = 1_000_000 if g.get("s") else MINUTE_US if g.get("mi") else 60 * MINUTE_US
        part = _whole(fraction) * unit // 10 ** len(fraction)
    if h > 23:
        return DAY_US if iso and h == 24 and mi == s == part == 0 else None
    return (h * 60 + mi) * MINUTE_US + s * 1_000_000 + part


_AS_FIVE = str.maketrans("0123456789", "5" * 10)


#: Longer texts, which are rare, are not remembered by their shape, and white space in them is drawn together so that matching stays linear.
SHORT = 80


@lru_cache(maxsize=65536)
def _fitting(shape: str) -> list[tuple[str, re.Pattern[str], str]]:
    """The notations that a text of this shape, its digits all written 5, can be in."""
    return [x for x in NOTATIONS if x[1].match(shape)]


def interpretations(text: str | None, zone: str | None, place: str | None, order: str | None, day: int | None) -> list[tuple[int, str, bool]]:
    """Every valid interpretation of a text: (UTC microseconds, notation, whether the source's conventions allow it).

    zone: the zone or offset that holds where the text has none; place: the IANA zone of the place, for abbreviations;
    order: DMY or MDY for numeric dates, None if unknown; day: days since 1970 to which a bare time belongs.
    """
    text = "" if text is None else text.strip()
    found: dict[tuple[int, str, bool], None] = {}
    if not text:
        return []
    if len(text) > SHORT:
        text = re.sub(r"\s+", " ", text)
    for notation, pattern, kind in _fitting(text.translate(_AS_FIVE)) if len(text) <= SHORT else NOTATIONS:
        match = pattern.match(text)
        if match is None:
            continue
        g = match.groupdict()
        if kind == "epoch":
            found[(int(g["epoch"]) * (1_000_000 if notation == "epoch_s" else 1000), notation, True)] = None
            continue
        clock = _clock(g, notation in _ISO)
        if clock is None:
            continue
        days: list[tuple[int | None, str, bool]] = []
        if kind == "ymd":
            days = [(_day(int(g["y"]), int(g["m"]), int(g["d"])), notation, True)]
        elif kind == "ordinal":
            y, doy = int(g["y"]), int(g["doy"])
            first = _day(y, 1, 1)
            days = [(first + doy - 1 if first is not None and 1 <= doy <= 365 + (monthrange(y, 2)[1] == 29) else None, notation, True)]
        elif kind == "week":
            try:
                days = [(date.fromisocalendar(int(g["y"]), int(g["w"]), int(g["wday"])).toordinal() - 719163, notation, True)]
            except ValueError:
                days = []
        elif kind == "numeric":
            a, b, y = int(g["a"]), int(g["b"]), int(g["y"])
            days = [(_day(y, b, a), notation + "_dmy", order in (None, "DMY")), (_day(y, a, b), notation + "_mdy", order in (None, "MDY"))]
        elif kind == "named":
            m = _month(g["mon"])
            n = _day(int(g["y"]), m, int(g["d"])) if m else None
            if n is not None and (wd := g.get("wd")):
                k = (n + 3) % 7
                n = n if wd.lower() in (WEEKDAYS[k], WEEKDAY_NAMES[k]) else None
            days = [(n, notation, True)]
        elif kind == "time" and day is not None:
            days = [(day, notation, True)]
        if g.get("zone"):
            where = _zone(g["zone"], place)
        else:
            where = None if zone is None else ("zone", zone) if "/" in zone else _zone(zone, place)
        if where is None:
            continue
        for n, name, allowed in days:
            if n is None:
                continue
            local = n * DAY_US + clock
            if where[0] == "zone":
                instants = local_to_utc(local, where[1])
            else:
                instants = [local - where[1] * MINUTE_US]
            if kind == "time" and clock < DAY_US:
                instants = [u + (day - u // DAY_US) * DAY_US for u in instants]
            for u in instants:
                found[(u, name, allowed)] = None
    return [x for x in found if _in_range(x[0])]


_RANGE = (_micros(datetime(FIRST_YEAR, 1, 1, tzinfo=UTC)), _micros(datetime(LAST_YEAR + 1, 1, 1, tzinfo=UTC)))


def _in_range(us: int) -> bool:
    return _RANGE[0] <= us < _RANGE[1]


def best_path(states: list[list[tuple[int, str, bool]]], before: tuple[int, str] | None = None) -> list[tuple[int, float]]:
    """The cheapest choice of one interpretation per record (Viterbi) with its margin; records without any are passed over (-1, 0).

    The margin is what the cheapest path through another instant of the record costs more, infinite where there is no other.
    """
    chosen = [(-1, 0.0)] * len(states)
    known = [k for k, options in enumerate(states) if options]

    def step(p: tuple[int, str] | None, us: int, name: str) -> float:
        return 0.0 if p is None else NOTATION_SWITCH * (p[1] != name) + BACK_IN_TIME * (us < p[0])

    ahead: list[list[float]] = []
    costs: list[float] = [0.0]
    previous: list[tuple[int, str] | None] = [before]
    for k in known:
        costs = [min(c + step(p, us, name) for c, p in zip(costs, previous, strict=True)) + (0.0 if allowed else AGAINST_CONVENTION) for us, name, allowed in states[k]]
        previous = [(us, name) for us, name, _ in states[k]]
        ahead.append(costs)
    rest: list[float] = []
    later: list[tuple[int, str, bool]] = []
    for k, costs in zip(reversed(known), reversed(ahead), strict=True):
        options = states[k]
        rest = [min((step((us, name), u, m) + (0.0 if ok else AGAINST_CONVENTION) + r for (u, m, ok), r in zip(later, rest, strict=True)), default=0.0) for us, name, _ in options]
        later = options
        through = [c + r for c, r in zip(costs, rest, strict=True)]
        at = min(range(len(through)), key=through.__getitem__)
        chosen[k] = at, min((c for c, x in zip(through, options, strict=True) if x[0] != options[at][0]), default=float("inf")) - through[at]
    return chosen


INSTANT_SCHEMA = "tab string, rec_id long, epoch_us long, notation string, n_readings int, decided boolean"


def _reader(least_margin: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches in the order of (source, record): a source's records are held until one with a single interpretation, which no later record can change."""
        key: tuple | None = None
        before: tuple[int, str] | None = None
        held: list[tuple[str, int, list[tuple[int, str, bool]]]] = []

        def flush() -> list[tuple]:
            nonlocal before
            rows = []
            for (tab, rec, options), (k, margin) in zip(held, best_path([x[2] for x in held], before), strict=True):
                us, name, allowed = options[k] if k >= 0 else (None, None, False)
                decided = allowed and margin >= least_margin
                if k >= 0:
                    before = (us, name)
                rows.append((tab, rec, us if decided else None, name, len({u for u, _, ok in options if ok}), decided))
            held.clear()
            return rows

        for batch in batches:
            out = []
            cols = [batch[c].tolist() for c in ("tab", "rec_id", "text", "zone", "place", "date_order", "day", "source", "block")]
            for tab, rec, text, zone, place, order, day, source, block in zip(*cols, strict=True):
                if key != (source, block):
                    out += flush()
                    key, before = (source, block), None
                options = interpretations(text if isinstance(text, str) else None, zone if isinstance(zone, str) else None, place if isinstance(place, str) else None, order if isinstance(order, str) else None, None if pd.isna(day) else int(day))
                if held or len(options) > 1:
                    held.append((tab, rec, options))
                    if len(options) == 1:
                        out += flush()
                elif options:  # nothing to choose
                    us, name, allowed = options[0]
                    before = (us, name)
                    out.append((tab, rec, us if allowed else None, name, int(allowed), allowed))
                else:
                    out.append((tab, rec, None, None, 0, False))
            if out:
                yield _frame(out)
        if held:
            yield _frame(flush())

    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    tab, rec, us, name, n, decided = zip(*rows, strict=True)
    return pd.DataFrame({"tab": tab, "rec_id": pd.array(rec, "Int64"), "epoch_us": pd.array(us, "Int64"), "notation": name, "n_readings": n, "decided": decided})


def stamps(
    df: DataFrame, tab: str, rec_id: str, text: str, source: list[str], zone: Column | None = None, place: Column | None = None, date_order: Column | None = None, day: Column | None = None, records_per_chain: int = 65_536
) -> DataFrame:
    """The rows of ``df`` as ``resolve`` takes them, which gives one row (tab, rec_id, epoch_us, notation, n_readings, decided) for each.

    zone, place, date_order, day: see ``interpretations``. source: the columns that name the source whose record order (by
    ``rec_id``) the Viterbi pass follows; a chain restarts after ``records_per_chain`` ids, so that as ids are unique no task
    holds more of a source than that, however large the source. Null, empty, blank and unreadable texts, however long, give
    decided = false and no instant; a null source is a source of its own; repeated rows come out as often as they go in;
    columns of other names are ignored; an empty table gives an empty result.
    """
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(tab).alias("tab"),
        F.col(rec_id).cast("long").alias("rec_id"),
        F.col(text).cast("string").alias("text"),
        (none if zone is None else zone).alias("zone"),
        (none if place is None else place).alias("place"),
        (none if date_order is None else date_order).alias("date_order"),
        (F.lit(None).cast("int") if day is None else F.unix_date(day)).alias("day"),
        F.concat_ws("\u0001", F.lit(tab), *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in source)).alias("source"),
        F.coalesce(F.floor(F.col(rec_id) / records_per_chain), F.lit(-1)).cast("long").alias("block"),
    )


def resolve(*slim: DataFrame, least_margin: float = CONVENTION_MARGIN) -> DataFrame:
    """The instants of one or more tables prepared by ``stamps``, in one shuffle; ``least_margin`` says what may decide a record."""
    every = slim[0]
    for x in slim[1:]:
        every = every.unionByName(x)
    return every.repartition("source", "block").sortWithinPartitions("source", "block", "rec_id").mapInPandas(_reader(least_margin), INSTANT_SCHEMA)
