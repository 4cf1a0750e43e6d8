"""Bars from tables, files and records."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom import bars, bars_from_records, read_bars, resample, run_script
from tests.tapes import TAPES


def test_na_and_volume(spark):
    df = spark.createDataFrame([("a", 1, math.nan, None, math.inf, 2.0, None)], "symbol string, date long, open double, high double, low double, close double, volume double")
    r = bars(df, "symbol").first()
    assert r.open is None and r.high is None and r.low == math.inf and r.volume == 0.0


def test_renamed_columns_and_timestamps(spark):
    df = spark.createDataFrame([("x", datetime(2026, 1, 5, 14, 30), 1.0, 2.0, 0.5, 1.5)], "ticker string, ts timestamp, o double, h double, l double, c double")
    r = bars(df, "ticker", "ts", open="o", high="h", low="l", close="c").first()
    assert (r.symbol, r.open, r.high, r.low, r.close, r.volume) == ("x", 1.0, 2.0, 0.5, 1.5, 0.0)
    assert r.date % 60_000 == 0


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_files(spark, tmp_path, fmt):
    src = bars_from_records(spark, TAPES["wavy"][:30], "W")
    src.write.format(fmt).save(f"{tmp_path}/b")
    got = run_script(read_bars(spark, f"{tmp_path}/b", fmt), "plot(sma(close, 3))\n").per_bar().orderBy("bar_index").collect()
    want = run_script(src, "plot(sma(close, 3))\n").per_bar().orderBy("bar_index").collect()
    assert [(r.bar_index, r.p0) for r in got] == [(r.bar_index, r.p0) for r in want]


def test_resample_takes_first_and_last_by_time_then_order(spark):
    rows = [("a", datetime(2026, 1, 1, 0, 5), 2, 5.0), ("a", datetime(2026, 1, 1, 0, 5), 1, 4.0), ("a", datetime(2026, 1, 1, 0, 59), 3, 9.0), ("a", datetime(2026, 1, 1, 2, 0), 4, 1.0), ("a", None, 5, 7.0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, id long, v double")
    got = resample(df, "s", "ts", "v", ("id",), "1 hour").orderBy("date").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(4.0, 9.0, 4.0, 9.0, 3.0), (1.0, 1.0, 1.0, 1.0, 1.0)]


def test_order_of_equal_dates(spark):
    df = spark.createDataFrame([("a", k, 5, float(k)) for k in (3, 1, 2)], "symbol string, seq long, date long, close double")
    for c in ("open", "high", "low"):
        df = df.withColumn(c, df.close)
    b = bars(df, "symbol", order="seq")
    for exact in (False, True):
        assert [r.p0 for r in run_script(b, "plot(close)\n", exact=exact).per_bar().orderBy("bar_index").collect()] == [1.0, 2.0, 3.0]


def test_records_skip_what_is_not_a_bar(spark):
    assert bars_from_records(spark, [{"date": 1, "close": 2}, None, "x", {"date": True}]).count() == 2


def test_zoneless_times_are_utc_in_any_session(spark):
    from datetime import date, datetime

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(datetime(2026, 1, 5, 14, 30, 0, 250_000), date(2026, 3, 8), 1.0)], "t timestamp_ntz, d date, close double").selectExpr("*", "close open", "close high", "close low")
        assert bars(df, date="t").first().date == 1767623400250
        assert bars(df, date="d").first().date == 1772928000000
        assert resample(df.withColumn("s", F.lit("x")), "s", "t", "close", (), "1 day").first().date == 1767571200000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_equal_dates_have_one_order(spark):
    rows = [(0, float(k), float(k), float(k), float(k)) for k in range(50)]
    make = lambda r: bars(spark.createDataFrame(r, "date long, open double, high double, low double, close double").repartition(5))
    read = lambda d, exact: [x.p0 for x in run_script(d, "plot(close)\n", exact=exact).per_bar().orderBy("bar_index").collect()]
    assert read(make(rows), False) == read(make(rows[::-1]), False) == read(make(rows[::-1]), True)


def test_a_far_instant_fails_no_other_symbol(spark):
    d = bars_from_records(spark, [{"date": 1767623400000, "open": 1, "high": 1, "low": 1, "close": 1, "volume": 1}], "a")
    d = d.unionByName(d.selectExpr("'b' symbol", "seq", "date * 1000000 date", "open", "high", "low", "close", "volume"))
    got = {r.symbol: (r.p0, r.error) for r in run_script(d, "plot(year(time * 1000))\n", {"timezone": "UTC"}, exact=True).per_bar().collect()}
    assert got["a"] == (57983.0, None) and got["b"][1] is None
