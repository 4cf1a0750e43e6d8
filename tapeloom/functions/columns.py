"""Column forms of the language's scalar semantics. na is NULL: a NaN that arithmetic makes goes back to NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def na() -> Column:
    return F.lit(None).cast("double")


def clean(c: Column) -> Column:
    return F.nanvl(c, na())


def flag(c: Column) -> Column:
    """A condition as 1 or 0; NULL (a comparison with na) is 0."""
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def truthy(c: Column, string: bool = False) -> Column:
    return F.coalesce(c != ("" if string else 0.0), F.lit(False))


def add(a: Column, b: Column) -> Column:
    return clean(a + b)


def subtract(a: Column, b: Column) -> Column:
    return clean(a - b)


def multiply(a: Column, b: Column) -> Column:
    return clean(a * b)


def divide(a: Column, b: Column) -> Column:
    """IEEE division; Spark's own raises or gives NULL for a zero divisor."""
    signed = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf))
    return F.when(b == 0, signed).otherwise(clean(F.try_divide(a, b)))


def remainder(a: Column, b: Column) -> Column:
    return F.when(F.abs(a) < math.inf, F.when(F.abs(b) < math.inf, clean(F.try_mod(a, b))).otherwise(F.when(b.isNotNull(), a)))


def equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def round_half_up(x: Column) -> Column:
    low = _whole(F.floor, x)
    return F.when(F.abs(x) >= 2.0**52, x).otherwise(low + F.when(x - low >= 0.5, 1.0).otherwise(0.0))


def _whole(f, x: Column) -> Column:
    return F.when(F.abs(x) >= 2.0**52, x).otherwise(f(x).cast("double"))


def log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-math.inf)).when(x > 0, F.ln(x))


def all_or_na(result: Column, *parts: Column) -> Column:
    """least, greatest and averages skip NULL in SQL; here any na makes the result na."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, result)


#: One-argument functions.
UNARY = {
    "abs": F.abs, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "log": log, "exp": F.exp, "round": round_half_up,
    "floor": lambda x: _whole(F.floor, x), "ceil": lambda x: _whole(F.ceil, x), "sign": F.signum,
    "sin": lambda x: clean(F.sin(x)), "cos": lambda x: clean(F.cos(x)), "tan": lambda x: clean(F.tan(x)),
    "asin": lambda x: clean(F.asin(x)), "acos": lambda x: clean(F.acos(x)), "atan": F.atan,
}


def number_text(x: Column) -> Column:
    """ECMAScript number text for magnitudes from 1e-7 up to 1e21, where no exponent is written; others via Spark's digits."""
    raw = x.cast("string")  # shortest digits, with E notation outside 1e-3 .. 1e7
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, r"^-?([0-9.]+)", 1), r"\.0$", ""), r"\.", "")
    digits = F.regexp_replace(F.regexp_replace(digits, r"^0+", ""), r"0+$", "")
    point = F.length(F.regexp_extract(raw, r"^-?([0-9]+)", 1)) + F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(raw, r"E(-?[0-9]+)$", 1), F.lit("")), F.lit("S999")).cast("int"), F.lit(0))
    lead = F.length(F.regexp_extract(F.translate(F.regexp_extract(raw, r"^-?([0-9.]+)", 1), ".", ""), r"^(0*)", 1))
    n, k = point - lead, F.length(digits)
    body = (
        F.when((k <= n) & (n <= 21), F.concat(digits, F.repeat(F.lit("0"), n - k)))
        .when((n > 0) & (n <= 21), F.concat(F.substring(digits, F.lit(1), n), F.lit("."), F.substring(digits, n + 1, k)))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), digits))
        .otherwise(F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise(""), F.lit("e"), F.when(n > 0, "+").otherwise("-"), F.abs(n - 1).cast("string")))
    )
    text = F.concat(F.when(x < 0, "-").otherwise(""), body)
    return F.when(x.isNull(), "NaN").when(x == math.inf, "Infinity").when(x == -math.inf, "-Infinity").when(x == 0, "0").otherwise(text)


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("double")


# -- calendar


def offset_ms(t: Column, zone: str) -> Column:
    """The zone's offset at an instant given in ms (session time zone UTC)."""
    ts = F.timestamp_millis(t.cast("long"))
    return (F.unix_millis(F.from_utc_timestamp(ts, zone)) - F.unix_millis(ts)).cast("double")


def from_wall(wall_ms: Column, zone: str) -> Column:
    """Wall time to epoch with the offset refined once, which settles gaps and overlaps the same way everywhere."""
    first = wall_ms - offset_ms(wall_ms, zone)
    return wall_ms - offset_ms(first, zone)


def local(t: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(F.floor(t).cast("long")), zone)


#: Calendar extractors over local timestamps.
PARTS = {"year": F.year, "month": F.month, "dayofmonth": F.dayofmonth, "dayofweek": lambda d: F.dayofweek(d) - 1, "hour": F.hour, "minute": F.minute}


def part(name: str, t: Column, zone: str) -> Column:
    return PARTS[name](local(t, zone)).cast("double")


def anchor_key(anchor: str, t: Column, zone: str) -> Column:
    d = local(t, zone)
    if anchor == "week":
        return F.date_trunc("week", d).cast("long")
    return F.date_trunc("month" if anchor == "month" else "day", d).cast("long")
