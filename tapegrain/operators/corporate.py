"""Splits, distributions and total-return prices; point-in-time universes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import asof_join, by_time, so_far
from tapegrain.session import materialize


def factor_after(bars: DataFrame, splits: DataFrame, out: str = "split_factor") -> DataFrame:
    """Product of the split ratios whose ex-date lies after each bar.

    Splits are reduced to one row per (symbol, day); a suffix sum of logs over the union gives
    the product, without joining each bar to each split.
    """
    s = splits.groupBy("symbol", F.col("ex_date").alias("session")).agg(F.sum(F.log("ratio")).alias("_lr"))
    u = bars.withColumn("_bar", F.lit(0)).unionByName(s.withColumn("_bar", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy(F.desc("session"), "_bar").rowsBetween(Window.unboundedPreceding, 0)
    return (u.withColumn(out, F.exp(F.coalesce(F.sum("_lr").over(w), F.lit(0.0)))).where(F.col("_bar") == 0).drop("_bar", "_lr"))


def snap_ratio(r: Column, tol: float = 0.005, limit: int = 50) -> Column:
    """Nearest fraction n/d with n, d <= limit inside the tolerance; the smaller d wins."""
    cand = F.transform(F.sequence(F.lit(1), F.lit(limit)), lambda d: F.struct(
        F.round(F.abs(F.round(r * d) / d / r - 1), 12).alias("e"), d.alias("d"), (F.round(r * d) / d).alias("v"), F.round(r * d).alias("n")))
    best = F.array_min(F.filter(cand, lambda z: (z["e"] < tol) & (z["n"] >= 1) & (z["n"] <= limit * z["d"])))
    return F.coalesce(best["v"], r)


def applied_splits(src: DataFrame, min_step: float = 0.02, jump: float = 0.01, side: int = 10, gap_days: int = 7) -> DataFrame:
    """Split steps read from raw close over adjusted close, one per cluster of neighbouring jumps."""
    w = by_time("symbol", "session")
    f = src.withColumn("_f", F.log(F.col("close_raw") / F.col("close"))).where(F.col("_f").isNotNull())
    f = f.withColumns({"_d": F.abs(F.col("_f") - F.lag("_f").over(w)),
                       "_before": F.percentile("_f", F.lit(0.5)).over(w.rowsBetween(-side, -1)),
                       "_after": F.percentile("_f", F.lit(0.5)).over(w.rowsBetween(0, side - 1))})
    r = f.where((F.col("_d") > jump) & (F.abs(F.col("_before") - F.col("_after")) > min_step))
    r = r.select("symbol", F.col("session").alias("ex_date"), F.exp(F.col("_before") - F.col("_after")).alias("ratio"))
    we = by_time("symbol", "ex_date")
    new = F.coalesce((F.datediff("ex_date", F.lag("ex_date").over(we)) > gap_days).cast("int"), F.lit(1))
    r = r.withColumn("_new", new).withColumn("_c", F.sum("_new").over(so_far(we)))
    size = F.struct(F.abs(F.log("ratio")), -F.datediff("ex_date", F.lit("1970-01-01").cast("date")))
    return r.groupBy("symbol", "_c").agg(F.max_by(F.struct("ex_date", "ratio"), size).alias("z")).select("symbol", "z.*")


def validate_splits(splits: DataFrame, bars: DataFrame, raw: str = "close_raw") -> DataFrame:
    """Judge each step by the raw price across its ex-date: split, not_split or unchecked."""
    w = by_time("symbol", "session")
    b = bars.select("symbol", "session", (F.lag(raw).over(w) / F.col(raw)).alias("_obs"), F.row_number().over(w).alias("_rn"))
    s = asof_join(splits, b, "symbol", "ex_date", "session", {"_obs": "observed_ratio"}, direction="forward")
    lo, lr = F.log("observed_ratio"), F.log("ratio")
    ok = (F.abs(lr) >= 0.1) & (F.abs(lo - lr) < F.abs(lo))
    state = F.when(F.col("observed_ratio").isNull(), "unchecked").when(ok, "split").otherwise("not_split")
    s = s.withColumn("state", state)
    return s.withColumn("ratio", F.when(F.col("state") == "split", snap_ratio(F.col("ratio"))).otherwise(F.col("ratio")))


def adjust_daily(src: DataFrame, splits: DataFrame, dists: DataFrame) -> DataFrame:
    """Undo steps that were no splits, then rebuild split factor, distribution return, total-return
    close and the forward-anchored factor (1 on the first day, so later distributions never move it)."""
    w = by_time("symbol", "session")
    d = factor_after(src, splits.where(F.col("state") == "not_split"), "split_fix")
    d = d.withColumns({x: F.col(x) * F.col("split_fix") for x in ("open", "high", "low", "close")})
    d = d.withColumn("volume", F.col("volume") / F.col("split_fix"))
    d = factor_after(d, splits.where(F.col("state") != "not_split"), "split_factor")
    # a distribution counts on the first bar at or after its ex-date, never on the first bar
    bars = d.select("symbol", "session", F.col("session").alias("_at"))
    x = asof_join(dists.select("symbol", "ex_date", "amount"), bars, "symbol", "ex_date", "session", {"_at": "_at"}, direction="forward")
    amt = x.where(F.col("_at").isNotNull()).groupBy("symbol", F.col("_at").alias("session")).agg(F.sum("amount").alias("_amt"))
    d = d.join(amt, ["symbol", "session"], "left").withColumn("_rn", F.row_number().over(w))
    adj = F.when(F.col("_rn") > 1, F.coalesce("_amt", F.lit(0.0)) / F.col("split_factor")).otherwise(0.0)
    d = d.withColumns({"_adj": adj, "_prev": F.lag("close").over(w)})
    d = d.withColumns({"div_ret": F.coalesce(F.col("_adj") / F.col("_prev"), F.lit(0.0)),
                       "_g": F.coalesce(F.log((F.col("close") + F.col("_adj")) / F.col("_prev")), F.lit(0.0))})
    first = F.first("close").over(so_far(w))
    d = d.withColumn("tr_close", F.exp(F.sum("_g").over(so_far(w))) * first)
    return d.withColumn("tr_factor", F.col("tr_close") / F.col("close")).drop("_rn", "_amt", "_adj", "_prev", "_g")


def symbol_periods(current: DataFrame, renames: DataFrame, anchor: str | None = None) -> DataFrame:
    """(root, name, start, end): the days on which the entity that carries a ticker on ``anchor`` (default
    today) used each of its names, followed backwards and forwards through every rename.

    ``renames``: process_date, old_symbol, new_symbol. A name another entity takes, before or after, ends
    the period. Each pass follows all chains by one step; passes go on until none has a further name.
    """
    lo, hi = F.lit("1900-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    day_ = F.current_date() if anchor is None else F.lit(anchor).cast("date")
    good = "process_date is not null and old_symbol is not null and new_symbol is not null"
    r = materialize(renames.where(good).select(F.col("process_date").alias("d"), F.col("old_symbol").alias("old"), F.col("new_symbol").alias("new")).distinct(), "renames")
    base = current.select(F.col("ticker").alias("root")).distinct()
    into = r.where(F.col("d") <= day_).groupBy(F.col("new").alias("root")).agg(F.max("d").alias("_in"))
    leave = r.where(F.col("d") > day_).select(F.explode(F.array("old", "new")).alias("root"), "d").groupBy("root").agg(F.min("d").alias("_out"))
    own = base.join(into, "root", "left").join(leave, "root", "left")
    own = materialize(own.select("root", F.col("root").alias("name"), F.coalesce("_in", lo).alias("start"), F.coalesce(F.date_sub("_out", 1), hi).alias("end")), "periods")
    taken = r.select(F.col("new").alias("name"), F.col("d").alias("x"))
    left = r.select(F.col("old").alias("name"), F.col("d").alias("x"))
    out, level = own, own
    while True:  # earlier names
        prev = level.where(F.col("start") > lo).join(r, (F.col("name") == F.col("new")) & (F.col("start") == F.col("d"))).groupBy("root", "d").agg(F.min("old").alias("name"))
        older = prev.join(taken, "name", "left").groupBy("root", "d", "name").agg(F.max(F.when(F.col("x") < F.col("d"), F.col("x"))).alias("_in"))
        level = materialize(older.select("root", "name", F.coalesce("_in", lo).alias("start"), F.date_sub("d", 1).alias("end")), "periods")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    level = own
    while True:  # later names
        nxt = level.where(F.col("end") < hi).join(r, (F.col("name") == F.col("old")) & (F.date_add("end", 1) == F.col("d"))).groupBy("root", "d").agg(F.min("new").alias("name"))
        later = nxt.join(left, "name", "left").groupBy("root", "d", "name").agg(F.min(F.when(F.col("x") > F.col("d"), F.col("x"))).alias("_out"))
        level = materialize(later.select("root", "name", F.col("d").alias("start"), F.coalesce(F.date_sub("_out", 1), hi).alias("end")), "periods")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.distinct()


def in_periods(actions: DataFrame, periods: DataFrame, symbol: str, on: str) -> DataFrame:
    """Actions of the entity (column ``root``) that carried their ``symbol`` on the day ``on``.

    A name and a day belong to the few periods of that name, so an equality on the name with a filter on the days is enough.
    """
    p = periods.select("root", F.col("name").alias("_name"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    j = actions.join(p, (F.col(symbol) == F.col("_name")) & F.col(on).between(F.col("_start"), F.col("_end")))
    return j.drop("_name", "_start", "_end")


def distributions(actions: DataFrame, periods: DataFrame, bars: DataFrame, prices: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """(root, ex_date, amount_raw, kind, new_symbol): what a raw share paid, by ex-date inside the entity's series.

    ``bars``: root, session, open, close, close_raw; ``prices``: raw close by (symbol, session) under the names of the day. A spin-off
    is worth its ratio times the new company's raw close on the ex-date; without that price, or with a split the raw price
    contradicts (``splits`` with state and observed_ratio, no spin-off or special dividend within three days), the fall
    overnight from the raw close to the raw open stands in as an estimate, 0 if there is none.
    """
    cash = in_periods(actions.where("kind = 'cash_dividends' and rate <> 0 and ex_date is not null"), periods, "symbol", "ex_date")
    cash = cash.select("root", "ex_date", F.col("rate").alias("amount_raw"), F.when(F.col("special"), "special").otherwise("dividend").alias("kind"), F.lit(None).cast("string").alias("new_symbol"))
    spun = in_periods(actions.where("kind = 'spin_offs' and ex_date is not null"), periods, "source_symbol", "ex_date")
    price = prices.select(F.col("symbol").alias("new_symbol"), F.col("session").alias("ex_date"), F.col("close_raw").alias("_px"))
    ratio = F.coalesce("new_rate", F.lit(0.0)) / F.coalesce(F.nullif("source_rate", F.lit(0.0)), F.lit(1.0))
    spun = spun.join(price, ["new_symbol", "ex_date"], "left").select("root", "ex_date", F.coalesce(ratio * F.col("_px"), F.lit(0.0)).alias("amount_raw"), F.lit("spin_off").alias("kind"), "new_symbol")
    ends = bars.groupBy("root").agg(F.min("session").alias("_lo"), F.max("session").alias("_hi"))
    rows = cash.unionByName(spun).join(ends, "root").where((F.col("ex_date") > F.col("_lo")) & (F.col("ex_date") <= F.col("_hi"))).drop("_lo", "_hi")
    rows = rows.withColumn("kind", F.when((F.col("kind") == "spin_off") & (F.col("amount_raw") == 0), "spin_off_gap_estimate").otherwise(F.col("kind")))
    if splits is not None:
        near = rows.where(F.col("kind").isin("special", "spin_off", "spin_off_gap_estimate")).select("root", F.explode(F.sequence(F.date_sub("ex_date", 3), F.date_add("ex_date", 3))).alias("ex_date"))
        odd = splits.where("state = 'not_split' and observed_ratio > 1.02").select("root", "ex_date").join(near.distinct(), ["root", "ex_date"], "left_anti")
        rows = rows.unionByName(odd.select("root", "ex_date", F.lit(0.0).alias("amount_raw"), F.lit("misrecorded_split_gap_estimate").alias("kind"), F.lit(None).cast("string").alias("new_symbol")))
    fall = F.lag("close_raw").over(by_time("root", "session")) - F.col("open") * F.col("close_raw") / F.col("close")
    gaps = bars.select("root", "session", fall.alias("_gap"))
    j = asof_join(rows, gaps, "root", "ex_date", "session", {"_gap": "_gap"}, direction="forward")
    guess = F.col("kind").endswith("gap_estimate")
    return j.withColumn("amount_raw", F.when(guess, F.greatest(F.coalesce("_gap", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("amount_raw"))).drop("_gap")


def take_out_prices(actions: DataFrame, periods: DataFrame, bars: DataFrame, days: int = 10) -> DataFrame:
    """(root, last_day, price): cash per share of the merger that ended a series, within ``days`` of its last bar; the earliest of several."""
    last = bars.groupBy("root").agg(F.max("session").alias("last_day"))
    names = in_periods(last.join(periods.select("root", "name").distinct(), "root").withColumnRenamed("root", "_own"), periods, "name", "last_day").where("root = _own").select("root", "name", "last_day")
    m = actions.where("kind = 'cash_mergers' and rate <> 0").select(F.col("acquiree_symbol").alias("name"), F.coalesce("effective_date", "process_date").alias("_d"), "rate", "id")
    j = names.join(m, "name").where(F.abs(F.datediff("_d", "last_day")) <= days)
    return j.groupBy("root", "last_day").agg(F.min_by("rate", F.struct("_d", "id")).alias("price"))


# --- universe -----------------------------------------------------------------------------------

def month_starts(calendar: DataFrame) -> DataFrame:
    """First session of each month with its ordinal."""
    return (calendar.groupBy(F.date_trunc("month", "session").alias("_m"))
            .agg(F.min(F.struct("session", "ord")).alias("z")).select("z.*"))


def rank_liquidity(bars: DataFrame, rebalances: DataFrame, calendar: DataFrame, lookback: int, min_price: float,
                   min_dollar_volume: float, min_coverage: float) -> DataFrame:
    """Liquidity rank per rebalance date from the sessions strictly before it.

    Rebalance dates and sessions are calendar lists. Each rebalance is widened to the sessions of its
    lookback, a table of calendar size, and bars meet it by equality of the session.
    """
    rb = rebalances.select(F.col("session").alias("rebalance"), F.explode(F.sequence(F.col("ord") - lookback, F.col("ord") - 1)).alias("ord"))
    serves = calendar.join(rb, "ord").select("session", "rebalance")
    j = bars.join(F.broadcast(serves), "session").withColumn("_dv", F.col("close") * F.col("volume"))
    g = j.groupBy("rebalance", "symbol").agg(F.percentile("_dv", F.lit(0.5)).alias("median_dv"), F.max_by("close", "session").alias("last_close"),
                                             (F.count(F.lit(1)) / lookback).alias("coverage"))
    return g.where((F.col("coverage") >= min_coverage) & (F.col("last_close") >= min_price) & (F.col("median_dv") >= min_dollar_volume))


def one_per_company(ranked: DataFrame, company: str, order: str) -> DataFrame:
    """Keep the most liquid name of each company per rebalance date."""
    w = Window.partitionBy("rebalance", company).orderBy(F.desc(order), "symbol")
    return ranked.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_n(ranked: DataFrame, n: int, order: str) -> DataFrame:
    w = Window.partitionBy("rebalance").orderBy(F.desc(order), "symbol")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _conflicts(max_corr: float):
    """Pairs of one rebalance date whose returns correlate above ``max_corr`` over the sessions both have."""
    def run(group: pa.Table) -> pa.Table:
        symbol, session = group.column("symbol").to_numpy(), group.column("session").to_numpy().astype("int64")
        (names, i), (days, j) = np.unique(symbol, return_inverse=True), np.unique(session, return_inverse=True)
        x, held = np.zeros((len(names), len(days))), np.zeros((len(names), len(days)))
        ret = group.column("ret").to_numpy()
        # moments of a pair over its common sessions; shifting a series by its mean leaves them exact and small
        x[i, j] = ret - (np.bincount(i, weights=ret) / np.bincount(i))[i]
        held[i, j] = 1
        n = held @ held.T
        sx, sxx, sxy = x @ held.T, (x * x) @ held.T, x @ x.T
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb = n * sxx - sx * sx, n * sxx.T - sx.T * sx.T
            corr = (n * sxy - sx * sx.T) / np.sqrt(np.where((va > 1e-18) & (vb > 1e-18), va * vb, np.nan))
        rank, fresh = np.zeros(len(names), "int64"), np.zeros(len(names), bool)
        rank[i], fresh[i] = group.column("place").to_numpy(), group.column("fresh").to_numpy(zero_copy_only=False)
        kind = group.schema.field("symbol").type
        hit = (n >= 2) & (corr > max_corr) & (rank[:, None] < rank[None, :]) & fresh[None, :]
        # a name that a kept one rules out needs no other pair, and blocks none
        ruled = hit[~fresh].any(axis=0)
        hit[ruled] = False
        hit[np.ix_(fresh, ruled)] = False
        a, b = np.nonzero(hit)
        return pa.table({"rebalance": pa.array([group.column("rebalance")[0].as_py()] * len(a), pa.date32()), "better": pa.array(names[a], kind), "symbol": pa.array(names[b], kind)})
    return run


#: Most names of one date that are compared at once.
WIDEST_BLOCK = 1024


def uncorrelated(ranked: DataFrame, returns: Callable[[DataFrame], DataFrame], n: int, max_corr: float, company: str | None = None, block: int | None = None) -> DataFrame:
    """The first ``n`` names of each rebalance date's ranking, leaving out a name when a better one that is kept belongs
    to the same company or has returns correlated above ``max_corr``: (rebalance, symbol, place, pick).

    ``ranked``: rebalance, symbol, place (from 1), and the company column (null: none); ``returns`` gives rebalance, symbol, session,
    ret of the (rebalance, symbol) asked for.
    The ranking is read in blocks, the first of ``block`` names and each of the next twice as long up to ``WIDEST_BLOCK``, and only dates
    still short of ``n`` names go on to the next. Pairs are formed among the at most ``n`` names kept and those of the block, so their
    number follows the parameters, not the number of symbols, and a long run of alike names is passed in few blocks. Within a
    block the greedy choice is made in rounds for all dates at once: a name stays when no better undecided name conflicts with
    it, and goes when a kept one does.
    """
    block = block or 2 * n
    col = F.col(company) if company else F.lit(None).cast("string")
    every = materialize(ranked.select("rebalance", "symbol", "place", col.cast("string").alias("company")), "ranked")
    pick = F.row_number().over(Window.partitionBy("rebalance").orderBy("place"))
    kept, low = every.limit(0), 0
    while True:
        short = every.select("rebalance").distinct().join(kept.groupBy("rebalance").agg(F.count("*").alias("k")), "rebalance", "left").where(F.coalesce("k", F.lit(0)) < n).select("rebalance")
        fresh = every.where((F.col("place") > low) & (F.col("place") <= low + block)).join(short, "rebalance")
        if every.where(F.col("place") > low).join(short, "rebalance", "left_semi").isEmpty():
            break
        beside = kept.join(short, "rebalance").withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
        sample = returns(beside.select("rebalance", "symbol")).join(beside, ["rebalance", "symbol"]).select("rebalance", "symbol", "session", "ret", "place", "fresh")
        kind = dict(every.dtypes)["symbol"]
        clash = materialize(sample.groupBy("rebalance").applyInArrow(_conflicts(max_corr), f"rebalance date, better {kind}, symbol {kind}"), "conflicts")
        # names that kept ones rule out, then rounds among the rest
        gone = clash.join(kept.select("rebalance", F.col("symbol").alias("better")), ["rebalance", "better"]).select("rebalance", "symbol")
        same = fresh.join(kept.select("rebalance", "company").distinct(), ["rebalance", "company"]).select("rebalance", "symbol")
        live = materialize(fresh.join(gone.unionByName(same).distinct(), ["rebalance", "symbol"], "left_anti"), "live")
        while not live.isEmpty():
            blocked = clash.join(live.select("rebalance", F.col("symbol").alias("better")), ["rebalance", "better"]).select("rebalance", "symbol")
            first = Window.partitionBy("rebalance", "company").orderBy("place")
            behind = live.where("company is not null").withColumn("_k", F.row_number().over(first)).where("_k > 1").select("rebalance", "symbol")
            stay = materialize(live.join(blocked.unionByName(behind).distinct(), ["rebalance", "symbol"], "left_anti"), "stay")
            kept = kept.unionByName(stay)
            out = clash.join(stay.select("rebalance", F.col("symbol").alias("better")), ["rebalance", "better"]).select("rebalance", "symbol")
            out = out.unionByName(live.join(stay.select("rebalance", "company"), ["rebalance", "company"], "left_semi").select("rebalance", "symbol")).unionByName(stay.select("rebalance", "symbol"))
            live = materialize(live.join(out.distinct(), ["rebalance", "symbol"], "left_anti"), "live")
        kept = materialize(kept.withColumn("pick", pick).where(F.col("pick") <= n).drop("pick"), "kept")  # names beyond n decide nothing
        low, block = low + block, max(block, min(2 * block, WIDEST_BLOCK))
    return kept.withColumn("pick", pick).select("rebalance", "symbol", "place", "pick")


def window_returns(bars: DataFrame, rebalances: DataFrame, calendar: DataFrame, lookback: int, names: DataFrame) -> DataFrame:
    """(rebalance, symbol, session, ret) of ``names``: changes of close inside each date's lookback, from the second bar on.

    Names are some of each date, as many as a parameter says. They go to the bars with the first and last session of their lookback, so
    only bars of these names are widened and shuffled.
    """
    rb = rebalances.select(F.col("session").alias("rebalance"), F.explode(F.sequence(F.col("ord") - lookback, F.col("ord") - 1)).alias("ord"))
    spans = calendar.join(rb, "ord").groupBy("rebalance").agg(F.min("session").alias("_lo"), F.max("session").alias("_hi"))
    asked = names.select("rebalance", "symbol").distinct().join(F.broadcast(spans), "rebalance")
    prev = F.lag("close").over(Window.partitionBy("rebalance", "symbol").orderBy("session"))
    own = bars.join(F.broadcast(asked), "symbol").where(F.col("session").between(F.col("_lo"), F.col("_hi")))
    return own.select("rebalance", "symbol", "session", (F.col("close") / prev - 1).alias("ret")).where("ret is not null")


def membership_intervals(changes: DataFrame) -> DataFrame:
    """Continuous membership stretches from change rows (date, member list).

    Change dates are numbered; a member's consecutive numbers form one stretch, which ends the day
    before the first change row without the member.
    """
    dates = changes.select("date").distinct().withColumn("_o", F.row_number().over(Window.partitionBy().orderBy("date")))
    nxt = dates.select((F.col("_o") - 1).alias("_last"), F.date_sub("date", 1).alias("end"))
    m = changes.select("date", F.explode("tickers").alias("ticker")).distinct().join(F.broadcast(dates), "date")
    m = m.withColumn("_g", F.col("_o") - F.row_number().over(by_time("ticker", "_o")))
    g = m.groupBy("ticker", "_g").agg(F.min("date").alias("start"), F.max("_o").alias("_last"))
    return g.join(F.broadcast(nxt), "_last", "left").select("ticker", "start", "end")


def classify_survivors(members: DataFrame, bars: DataFrame, tail_cut: Column) -> DataFrame:
    """current, renamed_member, left_index_trading, delisted, delisted_distressed or no_data per key.

    The last ten closes and volumes make a fingerprint; a gone key with the fingerprint of a
    current key is that company under a new name.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("session"))
    t = bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 20)
    last20 = t.groupBy("symbol").agg(
        F.max("session").alias("last_bar"), F.count(F.lit(1)).alias("_n"),
        (F.max(F.when(F.col("_rn") == 1, F.col("close"))) / F.max("close") - 1).alias("_fall"),
        F.sha2(F.to_json(F.array_sort(F.array_agg(F.when(F.col("_rn") <= 10, F.struct(
            "_rn", F.round("close", 2).alias("c"), F.round("volume", -2).alias("v")))))), 256).alias("_fp"))
    m = members.join(last20, "symbol", "left")
    cur = m.where(F.col("end").isNull() & (F.col("_n") >= 10)).groupBy("_fp").agg(F.min("symbol").alias("renamed_to"))
    m = m.join(cur, "_fp", "left")
    label = (F.when(F.col("last_bar").isNull(), "no_data").when(F.col("end").isNull(), "current")
             .when((F.col("last_bar") >= tail_cut) & F.col("renamed_to").isNotNull(), "renamed_member")
             .when(F.col("last_bar") >= tail_cut, "left_index_trading")
             .when((F.col("_n") > 1) & (F.col("_fall") < -0.5), "delisted_distressed").otherwise("delisted"))
    m = m.withColumn("label", label)
    return m.select("symbol", "start", "end", "label", F.when(F.col("label") == "renamed_member", F.col("renamed_to")).alias("renamed_to"))
