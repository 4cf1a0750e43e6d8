"""Sources: any table as bars, and files as bars.

A bars DataFrame has symbol string, seq long, date long (ms since the epoch), open, high, low, close, volume double.
Order inside a symbol is (date, seq). na is NULL: NaN becomes NULL, a missing volume 0; infinities stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "symbol string, seq long, date long, open double, high double, low double, close double, volume double"
PRICES = ("open", "high", "low", "close")


def clean(c: Column) -> Column:
    """NaN to NULL."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def millis(c: Column, kind: str) -> Column:
    """Milliseconds since the epoch; dates and timestamps without a zone are read as UTC, whatever the session's zone."""
    if kind == "timestamp":
        return F.unix_millis(c)
    if kind not in ("timestamp_ntz", "date"):
        return c
    day = F.unix_date(c.cast("date")).cast("long") * 86_400_000
    if kind == "date":
        return day
    return day + (F.hour(c) * 60 + F.minute(c)) * 60_000 + F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("long")


def bars(df: DataFrame, symbol: str | Column | None = None, date: str | Column = "date", order: str | Column | None = None, **columns: str | Column) -> DataFrame:
    """df's rows as bars; columns: open=, high=, low=, close=, volume= where the names differ.

    Timestamps become ms, those without a zone and dates as UTC. Without `order`, bars of equal date are ordered by a
    hash of their values, so that runs agree; that reads all price columns, an `order` only those the script needs.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    d = col(date)
    d = millis(d, df.select(d.alias("d")).schema["d"].dataType.typeName())
    v = columns.get("volume", "volume" if "volume" in df.columns else F.lit(None))
    values = [*[clean(col(columns.get(p, p))) for p in PRICES], F.coalesce(clean(col(v)), F.lit(0.0))]
    out = [F.lit("") if symbol is None else col(symbol).cast("string"), F.xxhash64(*values) if order is None else col(order), d]
    out = [c.cast(t).alias(n) for c, t, n in zip(out, ("string", "long", "long"), ("symbol", "seq", "date"))]
    return df.select(*out, *[c.alias(n) for c, n in zip(values, (*PRICES, "volume"))])


def resample(df: DataFrame, symbol: str, ts: str, price: str, order: tuple[str, ...], bucket: str, volume: Column | None = None) -> DataFrame:
    """Bars from any table of events: one per symbol and time bucket ('4 hours', '1 day'); empty buckets give none.

    One aggregation with map-side combine: open and close are the prices at the least and greatest (ts, order).
    """
    key = F.struct(ts, *order)
    at = millis(F.col(ts), df.schema[ts].dataType.typeName())
    g = df.where(F.col(ts).isNotNull()).groupBy(F.col(symbol).cast("string").alias("symbol"), F.window(F.timestamp_millis(at), bucket).getField("start").alias("start"))
    out = g.agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), (F.count("*") if volume is None else F.sum(volume)).cast("double").alias("volume"))
    d = F.unix_millis("start")
    return out.select("symbol", F.lit(0).cast("long").alias("seq"), d.alias("date"), *[clean(F.col(p)).alias(p) for p in PRICES], F.coalesce("volume", F.lit(0.0)).alias("volume"))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Bars from files of any format Spark reads: parquet, orc, json, csv, or a catalog table (fmt='table')."""
    if fmt == "table":
        return bars(spark.table(path), **_names(spark.table(path)))
    reader = spark.read.options(**options)
    if fmt in ("json", "csv"):
        reader = reader.schema(SCHEMA)
    df = reader.format(fmt).load(path)
    return bars(df, **_names(df))


def _names(df: DataFrame) -> dict:
    return {"symbol": "symbol" if "symbol" in df.columns else None, "order": "seq" if "seq" in df.columns else None}


def bars_from_records(spark: SparkSession, records: list, symbol: str = "") -> DataFrame:
    """Bars from a list of JSON-like records (tests and small inputs); their order is kept by seq."""
    rows = []
    for k, r in enumerate(x for x in records if isinstance(x, dict)):
        read = lambda f: float(r[f]) if isinstance(r.get(f), (int, float)) and not isinstance(r.get(f), bool) else None  # noqa: B023, E731
        d = read("date")
        rows.append((symbol, k, None if d is None else int(d), *[read(f) for f in PRICES], read("volume") or 0.0))
    return spark.createDataFrame(rows, SCHEMA)
