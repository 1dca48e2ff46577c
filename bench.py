"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Bars times candidates a second is the unit that compares with a serial backtester: ``bar_candidates_per_sec`` has it
for the searches, over hourly bars as the queries have them and over minute bars, where there is work to share out.
A query's time is the median of its runs after a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINES = ["s19_tick_bars", "w3_ema", "k8_simulate", "a1_metrics", "j2_asof_funding", "w35_ols_residual", "f8_basket", "p_confluence_rules", "o1_sweep", "t9_cscv", "t1_monte_carlo", "o14_surface", "o9_walk_forward"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from quantspan import catalog
    from quantspan.operators import search, sweep
    from quantspan.sources import bars as src

    def over_minutes(s, d):
        return sweep.sweep(sweep.crosses(src.bars_from_events(s, d, "minute"), list(search.LOOKBACKS)))

    timed, times, start = {n: catalog.queries()[n] for n in HEADLINES} | {"o1_sweep_minutes": over_minutes}, {}, time.perf_counter()
    for name, query in timed.items():
        if name == "o1_sweep_minutes" and time.perf_counter() - start > 120:
            continue
        taken = []
        while not taken or (len(taken) < 4 and sum(taken) < 8 and time.perf_counter() - start < 45):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    hours, minutes = (src.bars_from_events(spark, sf_dir, unit).count() for unit in ("hour", "minute"))
    tried = len(search.LOOKBACKS)
    # the walk simulates every candidate twice, over windows of 250 bars every 100
    work = {"o1_sweep": hours * tried, "o9_walk_forward": 2 * hours * tried * 250 // 100, "o1_sweep_minutes": minutes * tried}
    rates = {k: round(v / times[k]) for k, v in work.items() if k in times}
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "bar_candidates_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
