"""Registered queries against DuckDB on the small tables: a spread over all areas."""

import pytest

import check_queries as Q

SF = "/root/testdata/sf0.001"
SPREAD = ["win01_sma", "win03_rsi", "win20_stock_regime", "win34_fair_value_gaps", "win30_cs_rank_unbounded", "jon01_asof_filings", "jon10_trailing_density", "jon26_dividends_received",
          "seq03_spells", "seq10_average_cost", "seq21_first_touch", "agg05_curve_metrics", "agg07_trades_by_group", "agg33_forecast_scores", "sca01_lexicon_sentiment", "sca06_relation_triples",
          "src18_insider_bulk", "src22_disclosure_parse", "sta02_cluster_bootstrap", "set07_opportunities", "stm05_streaming_bars", "win26_adjust_daily"]


@pytest.fixture(scope="module")
def con():
    return Q.duck(SF)


@pytest.mark.parametrize("name", SPREAD)
def test_query_matches_sql(spark, con, name):
    from tapegrain.plans import load_catalog
    fn, sql = load_catalog()[name]
    ok, msg = Q.compare(spark, con, SF, fn, sql)
    assert ok, msg


def test_entry_runs(spark):
    import __spark_entry__ as e
    assert e.entry(spark).limit(1).count() <= 1
    assert set(e.oracle_sql()) <= set(e.queries())
