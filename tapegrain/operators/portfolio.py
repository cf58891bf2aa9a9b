"""Positions, dividends, valuation and allocation of many portfolios at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import asof_join, by_time, so_far
from tapegrain.session import materialize


def dividends_received(tx: DataFrame, dividends: DataFrame) -> DataFrame:
    """Per-share amounts times the shares held on the ex-date (trades of that day included).

    Trades are netted per (portfolio, symbol, day). Shares stay the same from one trade day to the next, so a
    stretch receives them times the difference of the symbol's cumulative amounts at its ends: one as-of
    lookup per trade day, and no holder meets each ex-date.
    """
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    t = tx.groupBy("portfolio", "symbol", F.col("session").alias("_d")).agg(F.sum(signed).alias("_q"))
    per = dividends.groupBy("symbol", "ex_date").agg(F.sum("amount").alias("_a"), F.count(F.lit(1)).alias("_n"))
    w = so_far(by_time("symbol", "ex_date"))
    cum = per.select("symbol", "ex_date", F.sum("_a").over(w).alias("ca"), F.sum("_n").over(w).alias("cn"))
    at = asof_join(t, cum, "symbol", "_d", "ex_date", {"ca": "_ca", "cn": "_cn"}, allow_equal=False, block="year(_t)").fillna(0, ["_ca", "_cn"])
    whole = per.groupBy("symbol").agg(F.sum("_a").alias("_ta"), F.sum("_n").alias("_tn"))
    h = by_time(["portfolio", "symbol"], "_d")
    at = at.join(whole, "symbol").withColumns({"_sh": F.sum("_q").over(so_far(h)), "_na": F.coalesce(F.lead("_ca").over(h), F.col("_ta")), "_nn": F.coalesce(F.lead("_cn").over(h), F.col("_tn"))})
    at = at.where(F.col("_sh") > 0)
    g = at.groupBy("portfolio", "symbol").agg(F.sum(F.col("_sh") * (F.col("_na") - F.col("_ca"))).alias("received"), F.sum(F.col("_nn") - F.col("_cn")).alias("payments"))
    return g.where("payments > 0")


def average_cost(tx: DataFrame, keys=("portfolio", "symbol"), order=("session", "l_orderkey", "l_linenumber", "l_partkey")) -> DataFrame:
    """Shares held and average-cost basis after each trade; sells are capped at the shares held.

    Held shares are a running sum reflected at zero: sum minus its running minimum below zero. The
    cost basis is scaled by held / held-before at a sell and starts anew after a full sale, so it is
    an affine scan inside each stretch between full sales.
    """
    from tapegrain.operators.kernels import affine_scan, by_time, so_far
    w = by_time(keys, order)
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    d = tx.withColumn("_q", signed).withColumn("_S", F.sum("_q").over(so_far(w)))
    d = d.withColumn("held", F.col("_S") - F.least(F.min("_S").over(so_far(w)), F.lit(0.0)))
    d = d.withColumn("_prev", F.coalesce(F.lag("held").over(w), F.lit(0.0)))
    sell = F.col("side") == "sell"
    d = d.withColumn("_flat", (sell & (F.col("held") <= 0)).cast("int"))
    d = d.withColumn("_stretch", F.coalesce(F.sum("_flat").over(so_far(w, -1)), F.lit(0)))
    live = sell & (F.col("held") > 0)
    d = d.withColumns({"_s": F.when(live, F.log(F.col("held") / F.col("_prev"))).otherwise(0.0),
                       "_d": F.when(sell, 0.0).otherwise(F.col("qty") * F.col("price") + F.col("fee"))})
    d = affine_scan(d, [*keys, "_stretch"], list(order), [("_s", {"cost": "_d"})])
    return (d.withColumn("cost", F.when(F.col("_flat") == 1, 0.0).otherwise(F.col("cost")))
            .drop("_q", "_S", "_prev", "_flat", "_stretch", "_s", "_d"))


def positions(tx: DataFrame, keys=("portfolio", "symbol"), order=("session", "l_orderkey", "l_linenumber", "l_partkey")) -> DataFrame:
    d = average_cost(tx, keys, order)
    return d.groupBy(*keys).agg(F.max_by(F.struct("held", "cost"), F.struct(*order)).alias("z")).select(*keys, "z.*")


def valuation(pos: DataFrame, quotes: DataFrame, dividends: DataFrame, sectors: DataFrame) -> DataFrame:
    """Market value, cost, open profit, dividends and the largest sector share per portfolio."""
    p = pos.where(F.col("held") > 0).join(quotes, "symbol").join(sectors.select("symbol", "sector"), "symbol")
    p = p.join(dividends.select("portfolio", "symbol", "received"), ["portfolio", "symbol"], "left")
    p = p.withColumn("_mv", F.col("held") * F.col("price"))
    s = p.groupBy("portfolio", "sector").agg(F.sum("_mv").alias("_mv"), F.sum("cost").alias("_c"), F.sum(F.coalesce("received", F.lit(0.0))).alias("_dv"),
                                             F.count(F.lit(1)).alias("_n"))
    g = s.groupBy("portfolio").agg(F.sum("_mv").alias("market_value"), F.sum("_c").alias("cost"), F.sum("_dv").alias("dividends"), F.sum("_n").alias("positions"),
                                   F.max("_mv").alias("_top"))
    return g.withColumns({"open_profit": F.col("market_value") - F.col("cost"), "top_sector_share": F.col("_top") / F.col("market_value")}).drop("_top")


def concentration(weights: DataFrame, key: str, weight: str) -> DataFrame:
    """Herfindahl index, effective number of bets and top-1 / top-3 weights, from one total per key."""
    tot = weights.groupBy(key).agg(F.sum(weight).alias("_t"), F.sum(F.col(weight) * F.col(weight)).alias("_q"), F.max(weight).alias("_m"))
    w = Window.partitionBy(key).orderBy(F.desc(weight))
    top = weights.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 3).groupBy(key).agg(F.sum(weight).alias("_t3"))
    return tot.join(top, key).select(key, (F.col("_q") / (F.col("_t") * F.col("_t"))).alias("hhi"), (F.col("_t") * F.col("_t") / F.col("_q")).alias("effective_bets"),
                                     (F.col("_m") / F.col("_t")).alias("top1"), (F.col("_t3") / F.col("_t")).alias("top3"))


def holdings_by_security(rows: DataFrame, filing: str, security: str, value: str, shares: str) -> DataFrame:
    """Holdings per filing and security; values reported in thousands are detected by their size."""
    mx = rows.groupBy(filing).agg(F.max(value).alias("_mx"))
    g = rows.groupBy(filing, security).agg(F.sum(value).alias("_v"), F.sum(shares).alias("shares")).join(mx, filing)
    g = g.withColumn("value", F.col("_v") * F.when(F.col("_mx") <= 1e8, 1000.0).otherwise(1.0))
    tot = g.groupBy(filing).agg(F.sum("value").alias("_t"))
    return g.join(tot, filing).withColumn("weight", F.col("value") / F.col("_t")).drop("_v", "_mx", "_t")


def contribution_growth(prices: DataFrame, weights: DataFrame, monthly: float) -> DataFrame:
    """Buying every month at fixed weights: shares, value, invested money and contribution-neutral growth.

    Nothing is ever sold, so shares are a running sum. ``prices`` holds one row per (symbol, session).
    """
    from tapegrain.operators.kernels import by_time, so_far
    p = prices.join(F.broadcast(weights), "symbol")
    buy = F.row_number().over(Window.partitionBy("symbol", F.date_trunc("month", "session")).orderBy("session")) == 1
    p = p.withColumn("_sh", F.when(buy, monthly * F.col("weight") / F.col("close")).otherwise(0.0))
    p = p.withColumn("_own", F.sum("_sh").over(so_far(by_time("symbol", "session"))))
    g = p.groupBy("session").agg(F.sum(F.col("_own") * F.col("close")).alias("value"), F.sum((F.col("_own") - F.col("_sh")) * F.col("close")).alias("_pre"),
                                 F.sum(F.col("_sh") * F.col("close")).alias("_in"))
    w = Window.partitionBy().orderBy("session")  # one row per session
    g = g.withColumn("_g", F.coalesce(F.log(F.col("_pre") / F.nullif(F.lag("value").over(w), F.lit(0.0))), F.lit(0.0)))
    g = g.withColumns({"invested": F.sum("_in").over(so_far(w)), "growth": F.exp(F.sum("_g").over(so_far(w)))})
    return g.withColumn("drawdown", F.col("growth") / F.max("growth").over(so_far(w)) - 1).drop("_pre", "_in", "_g")


def plan_orders(targets: DataFrame, positions: DataFrame, value: DataFrame, band: float = 0.25, min_order: float = 100.0) -> DataFrame:
    """Exit, trim, new or top-up orders where a position left the drift band around its target;
    buys are scaled to the money there is."""
    j = targets.join(positions, ["portfolio", "symbol"], "full").join(value, "portfolio")
    t, m = F.coalesce("weight", F.lit(0.0)) * F.col("value"), F.coalesce("market_value", F.lit(0.0))
    j = j.withColumns({"_t": t, "_m": m, "_gap": t - m})
    why = (F.when((F.col("_t") <= 0) & (F.col("_m") > 0), "exit").when((F.col("_m") <= 0) & (F.col("_t") > 0), "new")
           .when(F.col("_gap") < -band * F.col("_t"), "trim").when(F.col("_gap") > band * F.col("_t"), "top_up"))
    j = j.withColumn("reason", why).where(F.col("reason").isNotNull() & (F.abs("_gap") >= min_order))
    tot = j.groupBy("portfolio").agg(F.sum(F.when(F.col("_gap") > 0, F.col("_gap")).otherwise(0.0)).alias("_buys"),
                                     F.sum(F.when(F.col("_gap") < 0, -F.col("_gap")).otherwise(0.0)).alias("_sells"))
    j = j.join(tot, "portfolio")
    scale = F.when(F.col("_buys") > 0, F.least(F.lit(1.0), (F.col("cash") + F.col("_sells")) / F.col("_buys"))).otherwise(1.0)
    return j.select("portfolio", "symbol", "reason", F.when(F.col("_gap") > 0, F.col("_gap") * scale).otherwise(F.col("_gap")).alias("amount"))


def rebalance_plan(sleeves: DataFrame, cash: DataFrame, cap: float | None = None) -> DataFrame:
    """Spend new cash on under-weight sleeves, in proportion to their gaps; nothing is sold."""
    j = sleeves.join(cash, "portfolio")
    tot = sleeves.groupBy("portfolio").agg(F.sum("market_value").alias("_mv"))
    j = j.join(tot, "portfolio").withColumn("_gap", F.greatest(F.lit(0.0), F.col("weight") * (F.col("_mv") + F.col("cash")) - F.col("market_value")))
    g = j.groupBy("portfolio").agg(F.sum("_gap").alias("_gaps"))
    j = j.join(g, "portfolio")
    buy = F.when(F.col("_gaps") > 0, F.least(F.col("cash") * F.col("_gap") / F.col("_gaps"), F.col("_gap"), *([F.lit(cap)] if cap else []))).otherwise(0.0)
    return j.select("portfolio", "sleeve", buy.alias("buy"))


def internal_rate(flows: Column, steps: int = 80, per_year: int = 12, lo: float = -0.999999, widest: int = 24) -> Column:
    """Money-weighted annual return of a monthly flow array by bisection of the net present value.

    The upper end of the bracket doubles until the value changes sign; null where it never does.
    """
    def npv(rate: Column) -> Column:
        g = F.pow(1 + rate, F.lit(-1.0 / per_year))
        return F.aggregate(F.reverse(flows), F.lit(0.0), lambda acc, f: acc * g + f)

    at_lo = npv(F.lit(lo))
    tops = F.transform(F.sequence(F.lit(0), F.lit(widest)), lambda k: F.pow(F.lit(2.0), k))
    hi = F.get(F.filter(tops, lambda r: npv(r) * F.signum(at_lo) < 0), F.lit(0))
    start = F.struct(F.lit(lo).alias("lo"), hi.alias("hi"))

    def halve(acc: Column, _i: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = F.signum(npv(mid)) == F.signum(at_lo)  # the root lies above
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
    return F.when(hi.isNotNull(), (end["lo"] + end["hi"]) / 2)


# --- risk of whole books ------------------------------------------------------------------------

# Limits beyond which a book is warned of (fixed values).
LIMITS = {"single_critical": 0.35, "single": 0.20, "top3": 0.60, "sector": 0.50, "beta": 1.5, "stop_pct": 12.0}
#: Series in a tile of a book; pairs are worked out tile by tile.
TILE = 256


def _tile_links(min_corr: float):
    """Pairs of two tiles of one book whose returns move together, in either direction, over the same sessions."""
    def run(group: pa.Table) -> pa.Table:
        symbol, session = group.column("symbol").to_numpy(), group.column("session").to_numpy().astype("int64")
        (names, i), (days, j) = np.unique(symbol, return_inverse=True), np.unique(session, return_inverse=True)
        x, place, tile = np.zeros((len(names), len(days))), np.zeros(len(names), "int64"), np.zeros(len(names), "int64")
        x[i, j], place[i], tile[i] = group.column("ret").to_numpy(), group.column("place").to_numpy(), group.column("tile").to_numpy()
        x -= x.mean(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = x @ x.T / np.outer(norm, norm)
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        pair = (tile[:, None] == p) & (tile[None, :] == q) | (tile[:, None] == q) & (tile[None, :] == p)
        a, b = np.nonzero(pair & (np.abs(corr) >= min_corr) & (place[:, None] < place[None, :]))
        kind = group.schema.field("symbol").type
        book = pa.array([group.column("book")[0].as_py()] * len(a), group.schema.field("book").type)
        return pa.table({"book": book, "leader": pa.array(names[a], kind), "symbol": pa.array(names[b], kind)})
    return run


def clusters(held: DataFrame, returns: DataFrame, min_corr: float = 0.7, min_sessions: int = 30) -> DataFrame:
    """(book, leader, symbol): names of a book that move with a leader. ``held``: book, symbol, place (order in the book); ``returns``:
    symbol, session, ret.

    Correlations are taken over the sessions that all names of the book have, if there are more than ``min_sessions``. In the order of the
    book a name leads a cluster unless it belongs to an earlier leader's; leaders of all books are found together, in rounds.
    """
    series = held.join(returns.select("symbol").distinct(), "symbol", "left_semi")
    size = series.groupBy("book").agg(F.count("*").alias("_n"))
    common = series.join(returns, "symbol").groupBy("book", "session").agg(F.count("ret").alias("_k")).join(size, "book").where("_k = _n")
    enough = common.groupBy("book").agg(F.count("*").alias("_s")).where(F.col("_s") > min_sessions).select("book")
    tiles = F.ceil(F.col("_n") / TILE).cast("int")
    placed = series.join(enough, "book").join(size, "book").withColumn("tile", F.pmod(F.xxhash64("symbol"), tiles).cast("int"))
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), tiles - 1))).withColumns({"p": F.least("tile", "_o"), "q": F.greatest("tile", "_o")})
    rows = placed.select("book", "symbol", "place", "tile", "p", "q").join(common.select("book", "session"), "book").join(returns.select("symbol", "session", "ret"), ["symbol", "session"])
    book, kind = dict(held.dtypes)["book"], dict(held.dtypes)["symbol"]
    links = materialize(rows.groupBy("book", "p", "q").applyInArrow(_tile_links(min_corr), f"book {book}, leader {kind}, symbol {kind}"), "links")
    live = materialize(links.select("book", F.col("leader").alias("symbol")).distinct(), "live")
    found = None
    while not live.isEmpty():
        # a name leads when no undecided name before it is linked with it; those it is linked with lead no more
        behind = links.join(live.withColumnRenamed("symbol", "leader"), ["book", "leader"], "left_semi").select("book", "symbol").distinct()
        lead = materialize(live.join(behind, ["book", "symbol"], "left_anti").withColumnRenamed("symbol", "leader"), "lead")
        own = materialize(links.join(lead, ["book", "leader"], "left_semi"), "led")
        found = own if found is None else found.unionByName(own)
        done = own.select("book", "symbol").unionByName(lead.withColumnRenamed("leader", "symbol")).distinct()
        live = materialize(live.join(done, ["book", "symbol"], "left_anti"), "live")
    return links.limit(0) if found is None else found


def risk_review(holdings: DataFrame, facts: DataFrame, led: DataFrame) -> DataFrame:
    """One row for each book with holdings: weights, sector, beta, loss if all stops are hit, independent bets and warnings.

    ``holdings``: book, symbol, market_value; ``facts``: symbol, sector, beta, stop_pct, each of which may be null; ``led`` as from ``clusters``.
    Equal weights rank by symbol, equal sectors by name.
    """
    h = holdings.where("market_value > 0")
    total = h.groupBy("book").agg(F.sum("market_value").alias("_t"))
    h = h.join(total, "book").withColumn("w", F.col("market_value") / F.col("_t")).join(facts, "symbol", "left")
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("w"), "symbol"))
    top = h.select("book", "symbol", "w", rank.alias("r")).where("r <= 3").groupBy("book").agg(F.max_by("symbol", -F.col("r")).alias("largest"), F.max("w").alias("largest_weight"), F.sum("w").alias("top3_weight"))
    sector = h.where("sector is not null").groupBy("book", "sector").agg(F.sum("w").alias("sw")).groupBy("book").agg(
        F.min_by("sector", F.struct((-F.col("sw")).alias("a"), F.col("sector"))).alias("top_sector"), F.max("sw").alias("top_sector_weight"))
    known = F.when(F.col("beta").isNotNull(), F.col("w"))
    sums = h.groupBy("book").agg(F.count("*").alias("n_holdings"), F.sum("market_value").alias("market_value"), (F.sum(F.col("w") * F.col("beta")) / F.nullif(F.sum(known), F.lit(0.0))).alias("beta"),
                                 (F.sum(F.col("w") * F.least("stop_pct", F.when(F.col("stop_pct").isNotNull(), F.lit(0.5)))) * 100).alias("at_risk_pct"))
    bets = led.groupBy("book").agg(F.count("*").alias("_led"), F.countDistinct("leader").alias("n_clusters"))
    x = sums.join(top, "book").join(sector, "book", "left").join(bets, "book", "left").fillna(0, ["_led", "n_clusters"])
    c, lim = F.col, LIMITS
    said = F.array_compact(F.array(
        F.when(c("largest_weight") > lim["single_critical"], "critical:concentration").when(c("largest_weight") > lim["single"], "warning:concentration"),
        F.when((c("top3_weight") > lim["top3"]) & (c("n_holdings") > 3), "warning:top3"), F.when(c("top_sector_weight") > lim["sector"], "warning:sector"), F.when(c("beta") > lim["beta"], "warning:beta"),
        F.when(c("at_risk_pct") > lim["stop_pct"], "warning:stop_risk"), F.when(c("n_clusters") > 0, "warning:correlation")))
    return x.select("book", "n_holdings", F.greatest(F.lit(1), c("n_holdings") - c("_led")).alias("n_effective_bets"), "market_value", "largest", "largest_weight", "top3_weight", "top_sector", "top_sector_weight", "beta",
                    "at_risk_pct", "n_clusters", F.when(F.size(said) > 0, F.array_join(said, ",")).otherwise("info:ok").alias("warnings"))
