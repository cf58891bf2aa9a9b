"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["srt01_rank_universe", "win20_stock_regime", "win28_factors", "win04_macd", "win34_fair_value_gaps", "seq06_structure_events", "jon01_asof_filings",
            "jon10_trailing_density", "seq10_average_cost", "seq14_rank_portfolio", "seq21_first_touch", "seq07_clusters", "sta05_event_trades", "sta02_cluster_bootstrap",
            "agg05_curve_metrics", "agg06_trade_metrics", "agg33_forecast_scores", "agg22_quantiles", "set07_opportunities", "sca01_lexicon_sentiment", "sca03_headline_category",
            "src22_disclosure_parse", "win26_adjust_daily", "agg23_liquidity_rank"]


def main() -> None:
    from tapegrain.plans import load_catalog
    from tapegrain.session import build_session
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else None)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executor threads
    times = {}
    for name in HEADLINE:
        t = time.time()
        catalog[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}), flush=True)


if __name__ == "__main__":
    main()
