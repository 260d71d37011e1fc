"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores. Every query is
materialised in full through the ``noop`` sink; the first one also warms the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.plans.catalog import QUERIES  # noqa: E402
from tickloom.session import local_session  # noqa: E402

HEADLINE = [
    "resample_60min", "resample_all_frequencies", "weekly_bars", "daily_vwap", "main_contracts", "rollover_dates",
    "top_holders", "contract_position_summary", "rolling_hv", "rolling_hv_per_contract", "market_regimes",
    "market_environment", "asof_spot", "iv_benchmark", "iv_smile_snapshot", "chain_prices", "chain_greeks",
    "implied_vol_round_trip", "fifo_matched_trades", "trade_performance", "slippage_reconciliation",
    "monthly_account_summary", "fund_flows", "institution_features", "lead_lag_edges", "signals", "daily_anomaly_rules",
    "volume_anomalies", "catalog_completeness", "catalog_quality_scores", "missing_trading_dates", "tick_gaps",
    "tick_validation", "metric_histograms", "alert_breach_runs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "tickloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    only = os.environ.get("BENCH_ONLY")
    names = [n for n in HEADLINE if not only or n in only.split(",")]
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
