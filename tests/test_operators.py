"""Small hand-built cases and planted effects."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapegrain.functions import text as X
from tapegrain.operators import corporate as C
from tapegrain.operators import disclosures as D
from tapegrain.operators import events as V
from tapegrain.operators import portfolio as P
from tapegrain.operators import stats as S
from tapegrain.operators import structure as ST
from tapegrain.sources import readers as R


def d(s):
    return dt.date.fromisoformat(s)


def test_zones_match_a_plain_merge(spark, bars):
    b = ST.with_structure_base(bars).persist()
    s = ST.swings(b)
    ob, fv = ST.order_blocks(b), ST.gaps(b)
    z = ST.zones(b, s, ob, fv).toPandas()
    last = b.where("i = n - 1").toPandas().set_index("symbol")
    parts = [(r.symbol, r.direction, r.lower, r.upper) for r in ob.collect()] + [(r.symbol, r.direction, r.lower, r.upper) for r in fv.where("fill_session is null").collect()]
    for r in s.collect():
        if r.i >= max(r.n - 252, 0):
            h = last.loc[r.symbol, "atr"] / 2
            if r.swing_low is not None:
                parts.append((r.symbol, "bullish", r.swing_low - h, r.swing_low + h))
            if r.swing_high is not None:
                parts.append((r.symbol, "bearish", r.swing_high - h, r.swing_high + h))
    want = []
    for key in sorted({p[:2] for p in parts}):
        a, group = last.loc[key[0], "atr"], []
        for p in sorted((p for p in parts if p[:2] == key), key=lambda p: ((p[2] + p[3]) / 2, p[2])):
            mid = (p[2] + p[3]) / 2
            fits = group and abs(mid - group[-1][0]) <= a and max([g[2] for g in group] + [p[3]]) - min([g[1] for g in group] + [p[2]]) <= 2 * a
            if group and not fits:
                want.append((*key, min(g[1] for g in group), max(g[2] for g in group), len(group)))
                group = []
            group.append((mid, p[2], p[3]))
        want.append((*key, min(g[1] for g in group), max(g[2] for g in group), len(group)))
    got = sorted(map(tuple, z[["symbol", "direction", "lower", "upper", "strength"]].to_numpy().tolist()))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:2] == w[:2] and g[4] == w[4] and abs(g[2] - w[2]) < 1e-9 and abs(g[3] - w[3]) < 1e-9


def test_average_cost_caps_sales_and_restarts(spark):
    rows = [("a", 1, d("2020-01-01"), 1, "buy", 10.0, 5.0, 1.0), ("a", 1, d("2020-01-02"), 2, "sell", 4.0, 6.0, 0.0), ("a", 1, d("2020-01-03"), 3, "sell", 100.0, 7.0, 0.0),
            ("a", 1, d("2020-01-04"), 4, "buy", 2.0, 8.0, 0.0), ("a", 1, d("2020-01-05"), 5, "sell", 1.0, 9.0, 0.0)]
    t = spark.createDataFrame(rows, "portfolio string, symbol int, session date, l_orderkey int, side string, qty double, price double, fee double").withColumns({"l_linenumber": F.lit(1), "l_partkey": F.lit(1)})
    got = [(round(r.held, 9), round(r.cost, 9)) for r in P.average_cost(t).orderBy("session").collect()]
    assert got == [(10.0, 51.0), (6.0, 30.6), (0.0, 0.0), (2.0, 16.0), (1.0, 8.0)]


def test_internal_rate_recovers_a_known_rate(spark):
    g = 1.12 ** (1 / 12)
    flows = [-100.0] * 24
    end = sum(100 * g ** (24 - i) for i in range(24))
    s = spark.createDataFrame([(flows + [end],)], "flows array<double>")
    assert abs(s.select(P.internal_rate(F.col("flows")).alias("r")).first().r - 0.12) < 1e-6


def test_clusters_need_two_owners_value_and_cooldown(spark):
    rows = [(1, 10, d("2020-01-01"), 60e3), (1, 11, d("2020-01-20"), 60e3), (1, 12, d("2020-02-10"), 90e3), (1, 10, d("2020-09-01"), 70e3), (1, 11, d("2020-09-02"), 70e3),
            (2, 10, d("2020-01-01"), 90e3), (2, 10, d("2020-01-05"), 90e3), (3, 10, d("2020-01-01"), 60e3), (3, 11, d("2020-02-05"), 60e3)]
    t = spark.createDataFrame(rows, "issuer int, owner int, filed date, value double")
    got = [(r.issuer, r.signal_date, r.n_insiders, r.total_value) for r in D.detect_clusters(t).orderBy("signal_date").collect()]
    assert got == [(1, d("2020-01-20"), 2, 120e3), (1, d("2020-09-02"), 2, 140e3)]


def test_disclosure_layouts(spark):
    text = "\n".join(["Filing ID #200", "JT Big Maker Corporation", "Common Stock (BMC) [ST]", "S (partial) 09/04/2026 09/15/2026 $50,001 -", "$100,000", "F S: New", "S O: Family Trust",
                      "D: Sold half of the", "old position.", "SP Other Firm (OTH) [OP] P 01/02/2026 01/05/2026 $1,001 - $15,000", "Old Style Inc. (OLD) [ST] P", "02/03/2026 02/04/2026 $15,001 - $50,000"])
    r = D.parse_disclosures(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("rec").collect()
    assert [(x.owner, x.ticker, x.side, x.amount_min, x.amount_max) for x in r] == [("JT", "BMC", "sell_partial", 50001, 100000), ("SP", "OTH", "buy", 1001, 15000), ("", "OLD", "buy", 15001, 50000)]
    assert r[0].description == "Sold half of the old position." and r[0].subholding == "Family Trust" and r[0].asset_name == "Big Maker Corporation Common Stock"


def test_headline_rules(spark):
    rows = [("Acme beats earnings",), ("Acme said to be acquired by Zeta, acquisition announced",), ("Acme reportedly in talks",), ("Nothing here",)]
    c = X.classify(spark.createDataFrame(rows, "title string"), "title").collect()
    assert [x.category for x in c] == ["earnings_beat", "acquisition_target", "noise", "noise"]
    assert c[1].substantiation == "confirmed" and c[2].substantiation == "rumor"


def test_relations_take_the_nearest_names(spark):
    a = spark.createDataFrame([(1, "Alpha Corp invests $2 billion in Beta"), (2, "Beta only"), (3, "Alpha and Gamma say Beta partners with Delta")], "id int, title string")
    al = spark.createDataFrame([("alpha", "A"), ("alpha corp", "A"), ("beta", "B"), ("gamma", "G"), ("delta", "D")], "alias string, symbol string")
    r = X.relations(a, X.mentions(a, al, "id", "title"), "id", "title").orderBy("id").collect()
    assert [(x.id, x.actor, x.target, x.category) for x in r] == [(1, "A", "B", "strategic_investment"), (3, "B", "D", "partnership")]


def test_conflicts_need_proximity_and_no_boilerplate(spark):
    a = spark.createDataFrame([("Firm sold 39 bitcoin",), ("Bitcoin fans cheer while the company after long talks sold a plant",), ("Bitcoin: buy, sell or hold?",)], "title string").withColumn("ks", F.array(F.lit("bitcoin")))
    assert [r.matched for r in X.conflicts(a, "title", "ks").collect()] == ["sold"]


def test_factors_and_splits(spark):
    days = pd.bdate_range("2020-01-01", periods=40).date
    src = pd.DataFrame({"symbol": 1, "session": days, "close_raw": [400.0] * 20 + [100.0] * 20})
    src["close"] = 100.0
    s = spark.createDataFrame(src)
    got = C.validate_splits(C.applied_splits(s), s).collect()
    assert len(got) == 1 and got[0].ex_date == days[20] and got[0].ratio == 4.0 and got[0].state == "split"
    false = spark.createDataFrame(src.assign(close_raw=100.0, close=[25.0] * 20 + [100.0] * 20))
    assert C.validate_splits(C.applied_splits(false), false).first().state == "not_split"


def test_dividend_leaves_no_step_and_early_levels_stay(spark):
    days = pd.bdate_range("2020-01-01", periods=10).date
    src = spark.createDataFrame(pd.DataFrame({"symbol": 1, "session": days, **{x: [100.0] * 5 + [98.0] * 5 for x in ("open", "high", "low", "close")}, "volume": 1.0}))
    none = spark.createDataFrame([], "symbol bigint, ex_date date, ratio double, state string")
    div = spark.createDataFrame([(1, days[5], 2.0)], "symbol bigint, ex_date date, amount double")
    a = C.adjust_daily(src, none, div).orderBy("session").toPandas()
    np.testing.assert_allclose(a["tr_close"], 100.0)
    np.testing.assert_allclose(a["tr_factor"][:5], 1.0)


def test_membership_intervals(spark):
    ch = spark.createDataFrame([(d("2020-01-01"), ["A", "B"]), (d("2020-02-01"), ["A"]), (d("2020-03-01"), ["A", "B"])], "date date, tickers array<string>")
    got = sorted((r.ticker, r.start, r.end) for r in C.membership_intervals(ch).collect())
    assert got[1] == ("B", d("2020-01-01"), d("2020-01-31")) and got[0] == ("A", d("2020-01-01"), None) and got[2] == ("B", d("2020-03-01"), None)


def test_rename_chain(spark):
    cur = spark.createDataFrame([("C",)], "ticker string")
    ren = spark.createDataFrame([(d("2020-05-01"), "B", "C"), (d("2019-05-01"), "A", "B")], "process_date date, old_symbol string, new_symbol string")
    got = {r["name"]: (r.start, r.end) for r in C.symbol_periods(cur, ren).collect()}
    assert set(got) == {"A", "B", "C"} and got["B"] == (d("2019-05-01"), d("2020-04-30"))


def test_placebos_are_distinct_and_far(spark, bars):
    m = bars.where("symbol = 1").select("session", "open", "close")
    t = V.event_trades(bars, m, 10, 0.001, F.lit("2022-01-01").cast("date")).withColumn("median_dv_60", F.lit(1e9)).persist()
    buys = spark.createDataFrame([(1, d("2020-09-01")), (2, d("2020-10-01"))], "issuer bigint, filed date")
    c = V.placebo_candidates(t, buys, 10)
    ev = t.where("symbol in (1, 2) and i = 150")
    p = V.sample_placebos(ev, c).toPandas()
    assert (p.groupby("symbol").size() == 5).all() and not p.duplicated(["symbol", "c_rank"]).any()
    i1 = t.where("symbol = 1 and session >= '2020-09-01'").agg(F.min("i")).first()[0]
    assert (p[p.symbol == 1]["i"].sub(i1).abs() > 10).all()


def test_bootstrap_covers_the_mean_and_planted_shift(spark):
    rng = np.random.default_rng(8)
    v = pd.DataFrame({"id": range(4000), "m": rng.integers(0, 60, 4000), "v": rng.normal(0.0, 1.0, 4000)})
    s = spark.createDataFrame(v)
    b = S.cluster_bootstrap(s, "m", "v", 400).first()
    assert b.lo < v.v.mean() < b.hi and b.lo < 0 < b.hi
    assert S.cluster_bootstrap(s.withColumn("v", F.col("v") + 0.3), "m", "v", 400).first().lo > 0.15
    i = S.bootstrap_mean(s, ["id"], "v", 100).first()
    assert i.lo < v.v.mean() < i.hi


def test_first_touch_prefers_the_stop_and_fills_gaps_at_the_open(spark):
    days = pd.bdate_range("2020-01-01", periods=4).date
    rows = [(1, days[0], 10.0, 10.0, 10.0, 10.0, True, 1.0), (1, days[1], 10.0, 10.5, 9.5, 10.0, False, 1.0), (1, days[2], 8.0, 12.5, 7.0, 8.0, False, 1.0), (1, days[3], 8.0, 8.0, 8.0, 8.0, False, 1.0)]
    b = spark.createDataFrame(rows, "symbol int, session date, open double, high double, low double, close double, sig boolean, sd double")
    r = V.first_touch(b, "sig", "sd", max_hold=3).first()
    assert r.reason == "stop" and r.exit_price == 8.0 and r.exit_session == days[2]


def test_merge_reports_timing(spark):
    sch = "symbol string, date date, timing string"
    a = spark.createDataFrame([("X", d("2020-01-01"), "bmo"), ("Y", d("2020-01-01"), "unknown"), ("Z", d("2020-01-01"), "bmo")], sch)
    b = spark.createDataFrame([("X", d("2020-01-01"), "amc"), ("Y", d("2020-01-01"), "amc")], sch)
    got = {r.symbol: (r.timing, r.source) for r in R.merge_reports(a, b).collect()}
    assert got == {"X": ("unknown", "both"), "Y": ("amc", "both"), "Z": ("bmo", "a")}


def test_sessions_and_hours(spark):
    cal = R.sessions_from_rows(spark.createDataFrame([("2024-03-08", "09:30", "16:00"), ("2024-03-11", "09:30", "13:00")], "date string, open string, close string")).orderBy("session").collect()
    assert cal[0].open_ts.hour == 14 and cal[1].open_ts.hour == 13 and cal[1].early_close and not cal[0].early_close


def test_missing_and_huge_values_stay_in_their_frames(spark):
    from tapegrain.operators.kernels import by_time, roll_mean, roll_std, roll_sum
    rows = [(1, i, float("nan") if i == 5 else float(i % 7), 1e10 + (i % 7)) for i in range(400)]
    w = by_time("k", "i")
    b = spark.createDataFrame(rows, "k int, i int, x double, y double").select("i", roll_mean("x", w, 252).alias("m"), roll_sum("x", w, 60).alias("s"), roll_std("y", w, 40).alias("sd")).toPandas().set_index("i")
    assert np.isfinite(b.m[300]) and np.isnan(b.m[256]) and b.s[399] == sum(i % 7 for i in range(340, 400))
    assert abs(b.sd[399] - np.std([i % 7 for i in range(360, 400)], ddof=1)) < 1e-6


def test_rename_chains_of_any_length_both_ways(spark):
    ren = [(d(f"{2001 + k}-01-01"), f"N{k}", f"N{k + 1}") for k in range(8)]
    ren += [(d("2020-01-01"), "X", "N0"), (d("2000-01-01"), "N0", "OLD")]  # the first name belonged to others before and after
    r = spark.createDataFrame(ren, "process_date date, old_symbol string, new_symbol string")
    cur = spark.createDataFrame([("N4",)], "ticker string")
    got = {x["name"]: (str(x.start), str(x.end)) for x in C.symbol_periods(cur, r, "2004-06-01").collect()}
    assert set(got) == {f"N{k}" for k in range(9)}
    assert got["N4"] == ("2004-01-01", "2004-12-31")
    assert got["N8"] == ("2008-01-01", "9999-12-31") and got["N0"][1] == "2000-12-31"


def test_aliases_of_any_length(spark):
    a = spark.createDataFrame([("bank of new york mellon", 7), ("york", 8)], "alias string, symbol int")
    t = spark.createDataFrame([(1, "Shares of Bank of New York Mellon rose")], "id int, title string")
    assert [m.symbol for m in X.mentions(t, a, "id", "title").first().mentions] == [7]


def test_correlation_of_many_series(spark):
    from tapegrain.operators import evaluation as E
    from tapegrain.operators import joins as J
    rng = np.random.default_rng(3)
    x = rng.normal(size=(25, 600))
    p = pd.DataFrame([(i, t, float(x[t, i])) for t in range(25) for i in range(600)], columns=["symbol", "session", "ret"])
    r = spark.createDataFrame(p)
    got = J.pairwise_corr(r).toPandas()
    want = np.corrcoef(x.T)
    assert len(got) == 600 * 599 // 2 and np.allclose(got["corr"], want[got.a, got.b])
    c = E.shrunk_covariance(r, 1.0).toPandas()
    assert len(c) == 600 * 600 and np.allclose(c.sample_cov, np.cov(x.T)[c.a, c.b])


def test_correlation_forms_no_pairs_of_rows(spark):
    """Gaps, repeated sessions, missing, non-finite and constant values, values far from zero; pieces carry series, not pairs."""
    import math
    from tapegrain.operators import joins as J
    rng = np.random.default_rng(5)
    rows = [(f"s{i:03d}", t, float(rng.normal())) for i in range(150) for t in range(60) if rng.uniform() < 0.6]
    rows += [("const", t, 0.1) for t in range(60)] + [("far", t, 1e9 + (t % 7)) for t in range(60)] + [("split", t, 1e9 + t % 5 if t < 29 else t % 3 * 1e-3) for t in range(60)]
    rows += [("gaps", t, None if t % 4 == 0 else float(t % 9)) for t in range(60)] + [("nan", t, math.nan if t == 3 else float(t % 5)) for t in range(60)]
    rows += [("twice", t, float(t % 4 + k)) for t in range(60) for k in (0, 1)] + [("none", t, None) for t in range(60)]
    r = spark.createDataFrame(rows, "symbol string, session int, ret double")
    out = J.pairwise_corr(r)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(x.a, x.b): (x.corr, x.n) for x in out.collect()}
    by: dict = {}
    for a, t, x in rows:
        by.setdefault(a, {}).setdefault(t, []).append(x)
    names, want = sorted(by), {}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            p = [(x, y) for t in by[a].keys() & by[b].keys() for x in by[a][t] for y in by[b][t]]
            if len(p) >= 20:
                q = [(x, y) for x, y in p if x is not None and y is not None]
                u, v = (np.array(z) - z[0] for z in zip(*q)) if q else (np.zeros(0), np.zeros(0))
                with np.errstate(all="ignore"):
                    want[a, b] = (None if not q else np.corrcoef(u, v)[0, 1] if u.std() and v.std() else math.nan, len(p))
    assert got.keys() == want.keys() and len(got) > 3000
    for k, (x, n) in want.items():
        y, m = got[k]
        assert m == n and (x is None) == (y is None) and (x is None or (math.isnan(x) and math.isnan(y)) or abs(x - y) < 1e-8), (k, x, y)


def test_correlation_writes_each_series_once(spark, monkeypatch):
    """Series are not repeated for the tiles they meet, also where a part holds several tiles."""
    from tapegrain.operators import joins as J
    monkeypatch.setattr(J, "CORR_TILE", 64)
    monkeypatch.setattr(J, "CORR_PARTS", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(25, 400))
    r = spark.createDataFrame(pd.DataFrame([(i, t, float(x[t, i])) for t in range(25) for i in range(400)], columns=["symbol", "session", "ret"]))
    out = J.pairwise_corr(r)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.toPandas()
    assert len(got) == 400 * 399 // 2 and np.allclose(got["corr"], np.corrcoef(x.T)[got.a, got.b]) and (got.a < got.b).all()
    assert J.pairwise_corr(r.where("symbol < 0")).count() == 0


def test_folds_with_few_rows_stay(spark):
    from tapegrain.operators import learning as L
    rows = [(f, role, float(i), i % 2) for f, n in ((1, 5), (2, 80)) for role in ("train", "test") for i in range(n)]
    df = spark.createDataFrame(rows, "fold int, role string, a double, win int")
    got = L.fit_folds(df, ["a"], [1, 2])
    assert got.count() == 85 and got.where("fold = 1 and p is null and kept").count() == 5 and got.where("fold = 2 and p is not null").count() == 80


def test_poisson_draws_reach_the_tail(spark):
    from tapegrain.operators.kernels import poisson_one
    u = spark.createDataFrame([(0.0,), (0.5,), (1 - 1e-9,), (1 - 2.0 ** -53,)], "u double")
    got = [r[0] for r in u.select(poisson_one(F.col("u"))).collect()]
    assert got[:2] == [0.0, 1.0] and got[2] > 9 and got[3] > 15


def test_internal_rate_without_root_is_null(spark):
    s = spark.createDataFrame([([-1.0, -2.0],), ([-1.0] + [0.0] * 11 + [31.0],)], "flows array<double>")
    none, high = (r[0] for r in s.select(P.internal_rate(F.col("flows"))).collect())
    assert none is None and abs(high - 30) < 1e-4


def test_walk_forward_and_liquidity_have_no_nested_loop(spark):
    e = spark.createDataFrame([(d("2001-05-01"), d("2001-06-01")), (d("1999-05-01"), d("1999-06-01"))], "day date, out date")
    f = S.fold_dim(spark.createDataFrame([(1999,), (2001,)], "year int"), 1999, 10)
    w = S.walk_forward(e, f, "day", "out")
    assert "NestedLoop" not in w._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.fold, r.role) for r in w.collect()) == [(1999, "test"), (2001, "test"), (2001, "train")]


def test_vendor_documents_in_their_own_nesting(spark):
    xml = ("<ownershipDocument><issuer><issuerTradingSymbol>ABC</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>Doe J</rptOwnerName></reportingOwnerId>"
           "<reportingOwnerRelationship><isDirector>0</isDirector><isOfficer>1</isOfficer><isTenPercentOwner>true</isTenPercentOwner><officerTitle>Chief Cook</officerTitle></reportingOwnerRelationship></reportingOwner>"
           "<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2025-10-01</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding>"
           "<transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare>"
           "<transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts>"
           "<postTransactionAmounts><sharesOwnedFollowingTransaction><value>400</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>")
    r = R.form4_xml(spark.createDataFrame([(1, xml)], "doc_id int, xml string")).first()
    assert (r.symbol, r.owner, r.titles, str(r.date), r.code, r.shares, r.value, r.shares_owned_after) == ("ABC", "Doe J", ["Chief Cook", "10% holder"], "2025-10-01", "S", -100.0, -250.0, 400.0)
    chart = ('{"chart":{"result":[{"meta":{"symbol":"X","exchangeTimezoneName":"Asia/Tokyo"},"timestamp":[1700000000,1700000100,1700100000],"indicators":{"quote":[{"open":[1,2,null],"high":[1,4,5],"low":[1,2,3],'
             '"close":[1,4,5],"volume":[5,null,7]}],"adjclose":[{"adjclose":[1,2,5]}]}}],"error":null}}')
    b = R.chart_bars(spark.createDataFrame([(chart,), ('{"chart":{"result":null}}',)], "payload string")).collect()
    assert [(x.symbol, str(x.session), x.open, x.close, x.volume) for x in b] == [("X", "2023-11-15", 1.0, 2.0, 0.0)]
    facts = ('{"facts":{"us-gaap":{"Old":{"units":{"USD":[{"start":"2020-01-01","end":"2020-03-31","val":1,"filed":"2020-05-01","fp":"Q1","form":"10-Q"},{"start":"2020-01-01","end":"2020-03-31","val":9,"filed":"2021-05-01"}]}},'
             '"New":{"units":{"shares":[{"start":"2020-04-01","end":"2020-06-30","val":3,"filed":"2020-08-01","frame":"CY2020Q2"}]}}}}}')
    f = sorted((str(x.end), x.tag, x.val, x.fp, x.frame) for x in R.facts(spark.createDataFrame([(7, facts)], "cik int, facts string"), ["New", "Old"]).collect())
    assert f == [("2020-03-31", "Old", 1.0, "Q1", None), ("2020-06-30", "New", 3.0, None, "CY2020Q2")]


def test_regime_shape_reads_its_labels_once(spark):
    """Sessions and switches are sums over spells; a second reading would compute the regimes twice in one task."""
    from tapegrain.operators import regimes as G
    rng = np.random.default_rng(3)
    labels = {s: [str(x) if x != "-" else None for x in rng.choice(["bull", "bear", "range", "-"], 30)] for s in (1, 2)} | {3: [None] * 4, 4: ["bull"]}
    rows = [(s, d("2020-01-01") + dt.timedelta(days=i), x) for s, xs in labels.items() for i, x in enumerate(xs)] + [(None, d("2020-01-01"), "bull")]
    out = G.shape(spark.createDataFrame(rows, "symbol bigint, session date, regime string"))
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    want = {}
    for s, xs in labels.items():
        xs = [x for x in xs if x]
        starts = [i for i, x in enumerate(xs) if i == 0 or xs[i - 1] != x]
        for x in set(xs):
            k = sum(xs[i] == x for i in starts)
            want[s, x] = (k, xs.count(x) / k, xs.count(x), len(xs), len(starts) - 1, xs.count(x) / len(xs), (len(starts) - 1) / (len(xs) / 252.0))
    names = ("spells", "spell_mean", "label_sessions", "sessions", "switches", "share", "switches_per_year")
    assert {(r.symbol, r.label): tuple(r[n] for n in names) for r in out.collect()} == want


def test_agreement_query_computes_the_labels_once(spark):
    """Both sides of the comparison read the written labels; neither runs the windows that lead to them."""
    from tapegrain.plans import load_catalog
    d = "/root/testdata/sf0.001"
    out = load_catalog()["agg18_agreement"][0](spark, d)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    r = load_catalog()["win20_stock_regime"][0](spark, d).where("raw IS NOT NULL AND regime IS NOT NULL").toPandas()
    got = out.collect()[0]
    assert got.sessions == len(r) and (got.agreement is None) == (len(r) == 0)
    if len(r):
        assert abs(got.agreement - (r.raw == r.regime).mean()) <= 1e-6


def test_detection_deals_what_it_windows(spark, bars):
    """Windows over symbols run in as many tasks as the caller asks for, with the same rows."""
    import re
    from tapegrain.operators import regimes as G
    from tapegrain.plans import load_catalog
    b = bars.where("symbol < 3")
    labels = b.select("symbol", "session", F.when(F.col("close") > 103, "bull").when(F.col("close") < 97, "bear").when(F.col("close") > 98, "range").alias("regime"))
    e, dealt = G.drawdowns(b, 0.02), []
    deal = lambda rows, *keys: dealt.append(keys) or rows.repartition(3, *keys)
    want, got = G.detection(e, labels, b), G.detection(e, labels, b, deal=deal)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 3
    assert ("symbol",) in dealt and all(k[0] == "symbol" for k in dealt)
    plan = load_catalog()["seq05_detection"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(symbol#\w+, \d+\), ENSURE_REQUIREMENTS", plan)


def test_event_study_numbers_its_candidates_once(spark):
    """Both placebo draws read the written candidates; neither runs the windows that number them."""
    from tapegrain.plans import load_catalog
    out = load_catalog()["sta06_event_study"][0](spark, "/root/testdata/sf0.001")
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()
