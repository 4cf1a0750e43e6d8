"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tapeloom import bars_from_records, run_script  # noqa: E402
from tapeloom.functions.tapes import tape  # noqa: E402
from tapeloom.plans.fold import run_tape  # noqa: E402
from tapeloom.plans.queries import QUERIES, supplier_tape  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TRADER = """study("Crosses")
len = input.int(9, "Length")
fast = ema(close, len)
slow = ema(close, 21)
r = rsi(close, 14)
up = crossover(fast, slow) and r > 40
down = crossunder(fast, slow)
strategy.buy(up, 1, stop_loss=atr(14) * 2, take_profit=500)
strategy.sell(down, 1)
plot(fast)
plot(slow)
plotshape(up, location="belowbar")
infopanel(strategy.realized_pnl, title="P&L")
"""


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    headline = {n: QUERIES[n] for n in ("flagship", "fn_ema", "fn_rsi", "fn_percentile", "security_1d", "stmt_for", "many_tapes_window", "many_tapes_fold")}
    headline["many_tapes_trader"] = lambda s, d: run_script(supplier_tape(s, d), TRADER, {"timezone": "UTC"}).per_bar()
    headline["many_tapes_ema_native"] = lambda s, d: run_script(supplier_tape(s, d), "plot(ema(close, 9))\nplot(ema(close, 21))\nplot(rsi(close, 14))\n", {"timezone": "UTC"}).per_bar()
    headline["many_tapes_ema_windows"] = lambda s, d: run_script(supplier_tape(s, d), "plot(ema(close, 9))\n", {"timezone": "UTC"}).per_bar()
    # the published benchmark's tape, one symbol of 10,000 bars: the heaviest of scripts this bench has, and the plain pass without Spark
    wave = [{"date": 1767000000000 + i * 60_000, "open": c - 0.4, "high": c + 1, "low": c - 1, "close": c + 0.4, "volume": 1000} for i in range(10_000) for c in [100 + math.sin(i / 9) * 8 + i * 0.001]]
    one = bars_from_records(spark, wave, "wave").repartition(1).cache()
    headline["one_tape_10k_trader"] = lambda s, d: run_script(one, TRADER, {"timezone": "UTC"}).per_bar()
    headline["one_tape_10k_windows"] = lambda s, d: run_script(one, "plot(sma(close, 20))\nplot(stdev(close, 20))\nplotshape(crossover(close, sma(close, 5)))\n", {"timezone": "UTC"}).per_bar()
    seconds, rows = {}, {}
    for name, query in headline.items():
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up, as the published numbers have one
        began = time.time()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        rows[name] = query(spark, SF_DIR).count() if name.startswith(("many", "one")) else None
    plain_tape, options = tape(wave), {"timezone": "UTC"}
    run_tape(TRADER, plain_tape, options)
    began = time.time()
    run_tape(TRADER, plain_tape, options)
    seconds["one_tape_10k_pass"], rows["one_tape_10k_pass"] = round(time.time() - began, 4), 10_000
    rate = {n: round(r / seconds[n]) for n, r in rows.items() if r}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "bars_per_second": rate, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
