"""Calendar functions in the session's time zone, over milliseconds since the epoch."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

from tapeloom.plans.syntax import ScriptError

DEFAULT_ZONE = "America/New_York"
_TEXT = re.compile(r"\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*$")
_EPOCH = datetime(1970, 1, 1)
#: The calendar repeats after 400 years, weekdays included; instants that datetime can't hold are read a number of cycles away.
CYCLE_YEARS, CYCLE_DAYS = 400, 146_097
_FIRST, _LAST = -60_000_000_000, 250_000_000_000  # seconds within datetime's years whatever the zone
MOST_YEARS = 300_000


@lru_cache
def zone(name: str | None) -> ZoneInfo:
    try:
        if name == "local":
            local = datetime.now().astimezone().tzinfo
            return local  # type: ignore[return-value]
        return ZoneInfo(name or DEFAULT_ZONE)
    except Exception:
        raise ScriptError(f"unknown time zone {name!r}") from None


def wall(t: float, tz: ZoneInfo) -> tuple[datetime, int]:
    """The wall clock at t, and by how many cycles of 400 years its year is to be raised."""
    seconds = math.floor(t / 1000)
    cycles = 0 if _FIRST <= seconds <= _LAST else (seconds - (_FIRST if seconds < 0 else _LAST - CYCLE_DAYS * 86_400)) // (CYCLE_DAYS * 86_400)
    return datetime.fromtimestamp(seconds - cycles * CYCLE_DAYS * 86_400, UTC).astimezone(tz), cycles


def offset_ms(t: float, tz: ZoneInfo) -> float:
    return wall(t, tz)[0].utcoffset().total_seconds() * 1000  # type: ignore[union-attr]


def from_wall(wall_ms: float, tz: ZoneInfo) -> float:
    """Wall time to epoch: the offset at the wall time read as UTC, refined once."""
    first = wall_ms - offset_ms(wall_ms, tz)
    return float(wall_ms - offset_ms(first, tz))


def wall_days(year: int, month: int, day: int) -> int:
    """Days since the epoch; months and days may run over."""
    y, m = divmod(year * 12 + month - 1, 12)
    if abs(y) > MOST_YEARS:
        raise OverflowError(y)
    cycles, y = divmod(y - 2000, CYCLE_YEARS)
    return (datetime(2000 + y, m + 1, 1) - _EPOCH).days + cycles * CYCLE_DAYS + day - 1


def from_parts(tz: ZoneInfo, *parts: float) -> float:
    if any(p != p or math.isinf(p) for p in parts):
        return math.nan
    year, month, day, hour, minute, second = [int(p) for p in [*parts, *(0, 1, 1, 0, 0, 0)[len(parts) :]]]
    try:
        return from_wall(((wall_days(year, month, day) * 24 + hour) * 60 + minute) * 60_000.0 + second * 1000, tz)
    except (ValueError, OverflowError):
        return math.nan


def from_text(s: str, tz: ZoneInfo) -> float:
    m = _TEXT.match(s)
    return from_parts(tz, *[float(x or 0) for x in m.groups()]) if m else math.nan


#: Name of each extractor and what it reads.
PARTS = {
    "year": lambda d: d.year,
    "month": lambda d: d.month,
    "dayofmonth": lambda d: d.day,
    "dayofweek": lambda d: d.isoweekday() % 7,
    "hour": lambda d: d.hour,
    "minute": lambda d: d.minute,
}


def part(name: str, t, tz: ZoneInfo) -> float:
    if not isinstance(t, float) or t != t or math.isinf(t):
        return math.nan
    d, cycles = wall(t, tz)
    return float(PARTS[name](d) + (CYCLE_YEARS * cycles if name == "year" else 0))


def anchor_key(anchor: str, t: float, tz: ZoneInfo):
    """What stays equal while an anchor period lasts; NaN differs from everything."""
    if t != t:
        return math.nan
    d, cycles = wall(t, tz)
    if anchor == "week":
        return ((d.replace(tzinfo=None) - _EPOCH).days + cycles * CYCLE_DAYS + 3) // 7
    return (cycles, d.year, d.month) if anchor == "month" else (cycles, d.year, d.month, d.day)


def clock(s, default: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d{1,2}):(\d{2})", s or "")
    if not m or int(m[1]) > 23 or int(m[2]) > 59:
        m = re.fullmatch(r"(\d{1,2}):(\d{2})", default)
    return int(m[1]), int(m[2])  # type: ignore[index]


def now_scalars(last: float, tz: ZoneInfo, session: dict | None) -> dict[str, float]:
    """Scalars read from the latest bar's time."""
    names = ("current_datetime", "date_today", "market_open", "market_close")
    if last != last:
        return dict.fromkeys(names, math.nan)
    d, cycles = wall(last, tz)
    session = session or {}
    at = lambda h, m: from_parts(tz, float(d.year + CYCLE_YEARS * cycles), float(d.month), float(d.day), float(h), float(m))
    return dict(zip(names, (last, at(0, 0), at(*clock(session.get("open"), "09:30")), at(*clock(session.get("close"), "16:00")))))


