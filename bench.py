"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then RUNS times; the median counts.
Results go to Spark's no-op sink, so nothing is collected to the driver.
"""

import json
import os
import statistics
import time

from tickerloom.catalog import QUERIES
from tickerloom.session import local_session

HEADLINE = [
    "tb03_lagged_returns", "q02_bars", "q04_instrument_detail", "q03_instrument_news", "q05_concepts", "q08_run_with_entries", "q09_entry_detail",
    "q10_newest_report", "q11_latest_ranking", "q13_track_record", "q15_execution_summary", "q18_platform_totals", "q19_daily_cost", "q23_message_context",
    "q24_response_reuse", "tb05_kdj", "tb06_macd", "tb07_similar_patterns", "tb09_cross_signals", "tb10_rule_scores", "tb13_backtest_outcomes",
    "tb16_compare_audits", "tb20_coverage_gaps", "tc03_risk_adjusted_scores", "tc06_controllers", "str02_hourly_bars",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, partitions=int(cpus), memory="16g")
    seconds = {}
    for name in HEADLINE:
        spent = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(spent[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": runs, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
