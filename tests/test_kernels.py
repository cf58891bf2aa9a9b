"""Kernels against plain pandas or plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapegrain.functions import indicators as I
from tapegrain.operators import kernels as K


def test_ewm_matches_pandas_with_gaps(spark, walk):
    rng = np.random.default_rng(3)
    d = walk[["symbol", "session", "close"]].copy()
    d.loc[rng.random(len(d)) < 0.1, "close"] = np.nan
    d.loc[d.groupby("symbol").head(2).index, "close"] = np.nan
    s = spark.createDataFrame(d.astype({"close": object}).where(d.notna(), None), "symbol bigint, session date, close double")
    got = K.ewm(s, "symbol", "session", {"a": ("close", 1 / 14, 14), "b": ("close", 0.5, 1)}).toPandas().sort_values(["symbol", "session"])
    for col, a, mp in (("a", 1 / 14, 14), ("b", 0.5, 1)):
        want = d.groupby("symbol")["close"].transform(lambda x: x.ewm(alpha=a, adjust=False, min_periods=mp).mean())
        np.testing.assert_allclose(got[col].to_numpy(float), want.to_numpy(), rtol=1e-10)


def test_ewm_over_many_blocks(spark):
    n = 5000
    x = np.random.default_rng(5).normal(0, 1, n) + 50
    s = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(n), "x": x}))
    got = K.ewm(s, "k", "t", {"y": ("x", 0.5, 1)}).orderBy("t").toPandas()["y"]
    np.testing.assert_allclose(got, pd.Series(x).ewm(alpha=0.5, adjust=False).mean(), rtol=1e-12)


def test_rsi_bounds_and_warm_up(bars):
    r = I.add_rsi(bars).groupBy("symbol").agg(F.min("rsi_14").alias("lo"), F.max("rsi_14").alias("hi"), F.count("rsi_14").alias("n")).toPandas()
    assert (r.lo >= 0).all() and (r.hi <= 100).all() and (r.n == 300 - 14).all()


def test_unknown_indicator(bars):
    with pytest.raises(KeyError):
        I.with_indicators(bars, ["nope"])


@pytest.mark.parametrize("direction,equal", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
@pytest.mark.parametrize("block", [None, "floor(_t / 10)"])
def test_asof_matches_merge_asof(spark, direction, equal, block):
    rng = np.random.default_rng(1)
    l = pd.DataFrame({"k": rng.integers(0, 3, 200), "t": rng.integers(0, 100, 200), "id": range(200)})
    r = pd.DataFrame({"k": rng.integers(0, 3, 60), "u": rng.integers(0, 100, 60)}).drop_duplicates().reset_index(drop=True)
    r["v"] = range(len(r))
    got = K.asof_join(spark.createDataFrame(l), spark.createDataFrame(r), "k", "t", "u", {"v": "v"}, direction, equal, block).toPandas().sort_values("id")
    want = pd.merge_asof(l.sort_values("t"), r.sort_values("u"), left_on="t", right_on="u", by="k", direction=direction, allow_exact_matches=equal).sort_values("id")
    np.testing.assert_array_equal(got["v"].fillna(-1).to_numpy(), want["v"].fillna(-1).to_numpy())


def test_latch_and_confirm_match_loops(spark):
    rng = np.random.default_rng(2)
    n = 400
    x = rng.normal(0, 1, n)
    raw = [None if u < 0.1 else "abc"[int(u * 10) % 3] for u in rng.random(n)]
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(n), "x": x, "raw": raw}), "k int, t int, x double, raw string")
    w = K.by_time("k", "t")
    got = K.confirm(d.withColumn("st", K.latch(F.col("x") > 1, F.col("x") < -0.5, w)), "k", "t", "raw", 3, ("b",), "lab").orderBy("t").toPandas()
    st, on = [], False
    for v in x:
        on = True if v > 1 else False if v < -0.5 else on
        st.append(on)
    cur, last, run, lab = None, None, 0, []
    for v in raw:
        if v is not None:
            run = run + 1 if v == last else 1
            last = v
            if cur is None or v == "b" or run >= 3:
                cur = v
        lab.append(cur)
    assert got["st"].tolist() == st
    assert got["lab"].where(got["lab"].notna(), None).tolist() == lab


def test_ranks_and_quantiles_do_not_need_a_bound(spark):
    rng = np.random.default_rng(4)
    d = pd.DataFrame({"g": (rng.random(3000) < 0.7).astype(int), "v": np.round(rng.normal(0, 1, 3000), 2)})
    s = spark.createDataFrame(d)
    r = K.rank_in_group(s, ["g"], "v", "p").toPandas().sort_values(["g", "v"])
    want = d.assign(p=d.groupby("g")["v"].rank(pct=True) - 0.5).sort_values(["g", "v"])
    np.testing.assert_allclose(r["p"], want["p"], atol=1e-12)
    q = K.exact_quantiles(s, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).toPandas().set_index("g").sort_index()
    w = d.groupby("g")["v"].quantile([0.1, 0.5, 0.99]).unstack()
    np.testing.assert_allclose(q[["a", "b", "c"]].to_numpy(), w.to_numpy(), atol=1e-12)


def test_ranks_with_one_value_for_nearly_all_rows(spark):
    d = pd.DataFrame({"g": 1, "v": [7.0] * 2000 + list(range(20))})
    r = K.rank_in_group(spark.createDataFrame(d), ["g"], "v", "p").toPandas().sort_values("v")
    np.testing.assert_allclose(r["p"], (d.sort_values("v")["v"].rank(pct=True) - 0.5), atol=1e-12)


def test_blocked_running_sum(spark):
    d = pd.DataFrame({"k": 1, "t": range(100), "x": range(100)})
    s = spark.createDataFrame(d).withColumn("b", F.floor(F.col("t") / 7))
    got = K.blocked_running_sum(s, "k", ["t"], "b", {"x": "c"}).orderBy("t").toPandas()
    assert got["c"].tolist() == np.cumsum(range(100)).tolist()


def test_union_partitioning_shortcut_is_off(spark):
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


@pytest.mark.parametrize("frame", [1, 5, 40])
def test_moving_order_against_loops(spark, frame):
    """Medians of the rows before and shares below, over frames that lie in one block and reach into the one before."""
    from tapegrain.operators.kernels import moving_order
    rng = np.random.default_rng(frame)
    rows = [(k, t, None if rng.random() < 0.1 else float(rng.integers(0, 9))) for k in ("a", "b", None) for t in range({"a": 83, "b": 3, None: 40}[k])]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(4)
    by = {}
    for k, t, v in rows:
        by.setdefault(k, []).append(v)
    least = max(1, frame // 2)
    got = {(r["k"], r["t"]): r["m"] for r in moving_order(df, "k", "t", "x", frame, median=("m", least)).collect()}
    share = {(r["k"], r["t"]): (r["x"], r["s"]) for r in moving_order(df, "k", "t", "x", frame, below=("s", least)).collect()}
    assert len(got) == len(share) == len(rows)
    for k, values in by.items():
        for t, v in enumerate(values):
            before = [z for z in values[max(0, t - frame):t] if z is not None]
            assert got[k, t] == (float(np.median(before)) if len(before) >= least else None)
            here = values[max(0, t - frame + 1):t + 1]
            known = [z for z in here if z is not None]
            want = sum(z < v for z in known) / (len(here) - 1) if v is not None and len(known) >= least and len(here) > 1 else None
            assert share[k, t] == (v, want)


@pytest.mark.parametrize("n", [1, 4, 30])
def test_roll_moments_against_pandas(spark, n):
    """Counts, means and covariances of frames that lie in one block and in two; a huge or infinite value stays in its frames."""
    from tapegrain.operators.kernels import roll_moments
    rng = np.random.default_rng(n)
    rows = []
    for k, size in (("a", 95), ("b", 3), ("c", 61)):
        x, y = rng.normal(1e6, 1, size), rng.normal(size=size)
        gone = rng.random(size) < 0.15
        x[gone], y[gone] = np.nan, np.nan
        if size > 60:
            x[20], y[20] = 1e18, 1.0
            x[40], y[40] = np.inf, 1.0
        rows += [(k, t, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)) for t, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double").repartition(4)
    got = roll_moments(df, "k", "t", n, {"m": ("x", "y"), "v": ("y", "y")}).toPandas().sort_values(["k", "t"])
    for _, g in got.groupby("k"):
        for i in range(len(g)):
            f = g.iloc[max(0, i - n + 1):i + 1].dropna(subset=["x"])
            row = g.iloc[i]
            assert row.m_n == row.v_n == len(f)
            if not len(f) or not np.isfinite(f.x).all():
                continue
            assert abs(row.m_x - f.x.mean()) <= 1e-9 * abs(f.x).max() and abs(row.v_x - f.y.mean()) < 1e-9
            if len(f) > 1:
                assert abs(row.v_c - f.y.var()) < 1e-9 and abs(row.m_c - f.x.cov(f.y)) <= 1e-9 * max(1, abs(f.x - f.x.mean()).max())
            else:
                assert np.isnan(row.m_c)


def test_pieces_and_offsets_share_their_cut_points(spark):
    """Approximate cut points may come out differently each time they are computed, so only one computation may serve a result."""
    from tapegrain.operators.kernels import exact_quantiles, rank_in_group
    df = spark.range(0, 5000, 1, 8).selectExpr("id % 2 AS g", "CAST((id * 7919) % 3001 AS DOUBLE) AS x")
    q, r = exact_quantiles(df, ["g"], "x", {"m": 0.5}), rank_in_group(df, ["g"], "x")
    for out in (q, r):
        assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
    p = df.toPandas()
    assert {z.g: z.m for z in q.collect()} == p.groupby("g").x.median().to_dict()


def test_window_tasks_follow_the_lines(spark, tmp_path):
    """Twice the lines are twice the tasks, not tasks of twice the rows; a symbol stays in one task."""
    from tapegrain import bindings as B
    n = 3 * B.TASK_LINES
    d = str(tmp_path)
    spark.range(n).selectExpr("id AS l_orderkey", "id % 7 AS l_partkey", "id % 50 AS l_suppkey", "1 AS l_linenumber", "1D AS l_quantity", "CAST(id % 9 AS DOUBLE) AS l_extendedprice", "0D AS l_discount", "0D AS l_tax",
                              "'N' AS l_returnflag", "timestamp_seconds(id % 5 * 86400) AS l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    assert B.spread(spark.range(1), spark, d, "id", rows=n // 40).rdd.getNumPartitions() == 40
    b = B.symbol_bars(spark, d).withColumn("p", F.spark_partition_id())
    got = b.groupBy("symbol").agg(F.countDistinct("p").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert len(got) == 50 and all(r.n == 1 for r in got) and sum(r.rows for r in got) == b.count()


def _sorts(df):
    import re
    return len(re.findall(r"\bSort \[", df._jdf.queryExecution().executedPlan().toString()))


def test_confirm_and_scans_keep_the_order_of_the_series(spark, bars):
    """A sort holds all rows of its task; confirm takes the one it is given, a scan one for its blocks, the next window one more."""
    d = bars.repartition(4, "symbol")
    raw = d.withColumn("raw", F.when(F.col("close") > F.lag("close").over(K.by_time("symbol", "session")), "up").otherwise("down"))
    assert _sorts(K.confirm(raw, "symbol", "session", "raw", 2, ("down",), "label")) == _sorts(raw) == 1
    assert _sorts(I.add_ema(I.add_atr(d), 12)) == 4


@pytest.mark.parametrize("days,immediate", [(1, ()), (2, ("c",)), (3, ())])
def test_confirm_of_several_series_with_gaps(spark, days, immediate):
    rng = np.random.default_rng(days)
    raw = [None if x == 3 else "abc"[x] for x in np.repeat(rng.integers(0, 4, 240), rng.integers(1, 4, 240))]
    rows = [(i % 3 if i % 5 else None, i, v) for i, v in enumerate(raw)]
    got = {r.t: r.lab for r in K.confirm(spark.createDataFrame(rows, "k int, t int, raw string").repartition(4), "k", "t", "raw", days, immediate, "lab").collect()}
    state = {}  # key: label, raw of the live row before, length of its run
    for k, t, v in rows:
        lab, prev, n = state.get(k, (None, None, 0))
        if v is not None:
            n = n + 1 if v == prev else 1
            lab = v if prev is None or n >= days or v in immediate else lab
            prev = v
        state[k] = (lab, prev, n)
        assert got[t] == lab


def test_a_series_that_looks_itself_up_is_not_shuffled(spark):
    """Rows that carry their look-ups give what the union of both sides gives, without another exchange."""
    rng = np.random.default_rng(8)
    rows = [(s, t, float(rng.normal()) if rng.uniform() < 0.9 else None) for s in range(5) for t in sorted(rng.choice(200, 60, replace=False).tolist())] + [(9, None, 1.0)]
    b = spark.createDataFrame(rows, "k int, t int, x double").repartition(3, "k")
    made = F.array(*[F.struct(F.col("t").alias("made"), F.lit(h).alias("h"), (F.col("t") + h).alias("due")) for h in (-3, 0, 7)])
    b = b.withColumn("asks", F.when(F.col("t") % 5 != 0, made))
    left = b.select("k", F.explode("asks").alias("z")).select("k", "z.*")
    for more in ({}, {"allow_equal": False}, {"direction": "forward"}):
        want = K.asof_join(left, b, "k", "due", "t", {"x": "y", "t": "at"}, **more)
        got = K.asof_join(None, b, "k", "due", "t", {"x": "y", "t": "at"}, carried="asks", **more)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_unbounded_ranks_deal_the_rows_once(spark):
    """Ranks come from one exchange of the rows and no join on the value; rows of a value of its own piece stay spread."""
    rng = np.random.default_rng(9)
    v = np.where(rng.uniform(size=6000) < 0.5, 0.0, rng.normal(size=6000))
    p = pd.DataFrame({"g": np.arange(6000) % 2, "v": v, "i": np.arange(6000)})
    r = K.rank_in_group(spark.createDataFrame(p).repartition(4), ["g"], "v", "p")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = r.toPandas().sort_values("i")
    want = p.groupby("g").v.rank(method="average") / p.groupby("g").v.transform("count") - 0.5
    assert np.allclose(got.p.to_numpy(), want.to_numpy())
