"""Price structure: swings, gaps, order blocks, breaks, sweeps, ranges and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.functions import indicators as I
from tapegrain.operators.kernels import by_time, so_far
from tapegrain.session import materialize

TINY = 1e-9


def _w():
    return by_time("symbol", "session")


def with_structure_base(bars: DataFrame) -> DataFrame:
    """Bar number and an average true range that starts with the first bar."""
    d = I.add_atr(bars, 14, out="atr", min_periods=1)
    return d.withColumns({"i": F.row_number().over(_w()) - 1,
                          "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})


def swings(d: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """Mark bars that are the strict extreme of the bars around them."""
    w = _w()
    before, after = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    inside = (F.col("i") >= left) & (F.col("i") < F.col("n") - right)
    hi = inside & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    lo = inside & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    return d.withColumns({"swing_high": F.when(hi, F.col("high")), "swing_low": F.when(lo, F.col("low"))})


def first_crossing(events: DataFrame, bars: DataFrame, level: str, from_i: str, side: str,
                   out: str = "cross_ts", block: int = 32) -> DataFrame:
    """First bar at or after ``from_i`` that trades at or through a level.

    ``side`` 'down' looks for low <= level, 'up' for high >= level. Bars are summarised in blocks
    of ``block``; an event meets block extremes first and then only the bars of one or two blocks,
    which replaces the search over every later bar.
    """
    down = side == "down"
    x = F.col("low") if down else F.col("high")
    b = bars.select("symbol", "i", "session", x.alias("_x")).withColumn("_blk", F.floor(F.col("i") / block))
    ext = b.groupBy("symbol", "_blk").agg((F.min if down else F.max)("_x").alias("_ext"))
    ev = events.withColumn("_eid", F.struct("symbol", from_i, level)).select("symbol", F.col(from_i).alias("_from"), F.col(level).alias("_lv")).distinct()
    ev = ev.withColumn("_b0", F.floor(F.col("_from") / block))
    hit = (lambda v: v <= F.col("_lv")) if down else (lambda v: v >= F.col("_lv"))
    later = (ev.join(ext, "symbol").where((F.col("_blk") > F.col("_b0")) & hit(F.col("_ext")))
             .groupBy("symbol", "_from", "_lv").agg(F.min("_blk").alias("_blk")))
    cand = later.unionByName(ev.select("symbol", "_from", "_lv", F.col("_b0").alias("_blk")))
    found = (cand.join(b, ["symbol", "_blk"]).where((F.col("i") >= F.col("_from")) & hit(F.col("_x")))
             .groupBy("symbol", F.col("_from").alias(from_i), F.col("_lv").alias(level)).agg(F.min("session").alias(out)))
    return events.join(found, ["symbol", from_i, level], "left")


_BASE = ["symbol", "session", "i", "n", "open", "high", "low", "close", "atr"]


def gaps(d: DataFrame, min_strength: float = 0.4, written: bool = False) -> DataFrame:
    """Three-bar imbalances and when price first came back through them.

    The bars are read by several joins and are written once first (``written``: they already were).
    """
    d = d if written else materialize(d.select(*_BASE), "structure")
    w = _w()
    ph, pl, nh, nl = F.lag("high").over(w), F.lag("low").over(w), F.lead("high").over(w), F.lead("low").over(w)
    g = d.withColumns({"_ph": ph, "_pl": pl, "_nh": nh, "_nl": nl})
    up, dn = F.col("_ph") < F.col("_nl"), F.col("_pl") > F.col("_nh")
    g = g.withColumns({"direction": F.when(up, "bullish").when(dn, "bearish"),
                       "upper": F.when(up, F.col("_nl")).when(dn, F.col("_pl")),
                       "lower": F.when(up, F.col("_ph")).when(dn, F.col("_nh")),
                       "strength": F.abs(F.col("close") - F.col("open")) / F.greatest("atr", F.lit(TINY)),
                       "from_i": F.col("i") + 2})
    e = g.where(F.col("direction").isNotNull() & (F.col("strength") >= min_strength)).select(
        "symbol", "session", "i", "from_i", "direction", "upper", "lower", "strength")
    bull = first_crossing(e.where(F.col("direction") == "bullish"), d, "lower", "from_i", "down", "fill_session")
    bear = first_crossing(e.where(F.col("direction") == "bearish"), d, "upper", "from_i", "up", "fill_session")
    return bull.unionByName(bear).drop("from_i")


def order_blocks(d: DataFrame, bars_ahead: int = 3, min_impulse: float = 1.2, displacement: bool = True, written: bool = False) -> DataFrame:
    """Last opposite candle before a strong move, with displacement and first return into it."""
    d = d if written else materialize(d.select(*_BASE), "structure")
    w = _w()
    g = d.withColumns({"_gu": (F.lag("high").over(w) < F.lead("low").over(w)).cast("int"),
                       "_gd": (F.lag("low").over(w) > F.lead("high").over(w)).cast("int")})
    leg = w.rowsBetween(1, bars_ahead - 1)
    g = g.withColumns({"_du": F.max("_gu").over(leg), "_dd": F.max("_gd").over(leg),
                       "_imp": (F.lead("close", bars_ahead).over(w) - F.col("close")) / F.greatest("atr", F.lit(TINY)),
                       "_nx": F.lead("close", 1).over(w)})
    room = (F.col("i") >= 1) & (F.col("i") < F.col("n") - bars_ahead)
    need = lambda x: (F.col(x) == 1) if displacement else F.lit(True)
    bull = room & (F.col("close") < F.col("open")) & (F.col("_imp") >= min_impulse) & (F.col("_nx") > F.col("close")) & need("_du")
    bear = room & (F.col("close") > F.col("open")) & (-F.col("_imp") >= min_impulse) & (F.col("_nx") < F.col("close")) & need("_dd")
    e = (g.withColumn("direction", F.when(bull, "bullish").when(bear, "bearish")).where(F.col("direction").isNotNull())
         .select("symbol", "session", "i", (F.col("i") + bars_ahead + 1).alias("from_i"), "direction",
                 F.col("high").alias("upper"), F.col("low").alias("lower"), F.abs("_imp").alias("impulse")))
    b1 = first_crossing(e.where(F.col("direction") == "bullish"), d, "upper", "from_i", "down", "mitigated_session")
    b2 = first_crossing(e.where(F.col("direction") == "bearish"), d, "lower", "from_i", "up", "mitigated_session")
    return b1.unionByName(b2).drop("from_i")


def structure_events(s: DataFrame) -> DataFrame:
    """Breaks of the running swing extreme; a break against the last break changes character."""
    pts = s.select("symbol", "session", "i", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.col("swing_high").alias("price")),
        F.struct(F.lit(1).alias("k"), F.col("swing_low").alias("price")))).alias("z")).select(
        "symbol", "session", "i", "z.k", "z.price").where(F.col("price").isNotNull())
    pts = pts.withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("_cnt") >= 4)
    w = Window.partitionBy("symbol", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pts = pts.withColumns({"_hh": F.max("price").over(w), "_ll": F.min("price").over(w)})
    up, dn = (F.col("k") == 0) & (F.col("price") > F.col("_hh")), (F.col("k") == 1) & (F.col("price") < F.col("_ll"))
    b = pts.withColumns({"direction": F.when(up, "bullish").when(dn, "bearish"),
                         "broken_level": F.when(up, F.col("_hh")).when(dn, F.col("_ll"))}).where(F.col("direction").isNotNull())
    prev = F.lag("direction").over(Window.partitionBy("symbol").orderBy("i", "k"))
    kind = F.when(prev.isNotNull() & (prev != F.col("direction")), "CHOCH").otherwise("BOS")
    return b.withColumn("kind", kind).select("symbol", "session", "i", "k", "kind", "direction", "broken_level")


def sweeps(s: DataFrame, reversal: int = 3, threshold: float = 0.2, confirmed_only: bool = True, right: int = 3) -> DataFrame:
    """Wicks beyond the last swing that are reclaimed within a few closes.

    With ``confirmed_only`` a swing counts only once the bars that confirm it have closed.
    """
    w = _w()
    upto = so_far(w, -max(2, right) if confirmed_only else -2)
    ahead = w.rowsBetween(1, reversal)
    g = s.withColumns({"_sl": F.last("swing_low", ignorenulls=True).over(upto), "_sh": F.last("swing_high", ignorenulls=True).over(upto),
                       "_mx": F.max("close").over(ahead), "_mn": F.min("close").over(ahead)})
    a = F.greatest("atr", F.lit(TINY)) * threshold
    room = (F.col("i") >= 1) & (F.col("i") < F.col("n") - reversal)
    bull = room & (F.col("low") < F.col("_sl") - a) & (F.col("_mx") > F.col("_sl"))
    bear = room & (F.col("high") > F.col("_sh") + a) & (F.col("_mn") < F.col("_sh"))
    hits = F.array_compact(F.array(
        F.when(bull, F.struct(F.lit("bullish").alias("direction"), F.col("_sl").alias("swept_level"), F.col("_mx").alias("reversal_close"))),
        F.when(bear, F.struct(F.lit("bearish").alias("direction"), F.col("_sh").alias("swept_level"), F.col("_mn").alias("reversal_close")))))
    return g.select("symbol", "session", "i", F.explode(hits).alias("z")).select("symbol", "session", "i", "z.*")


def dealing_range(s: DataFrame, lookback: int = 90, eq_band: float = 0.05, deep: float = 0.62, deepest: float = 0.79) -> DataFrame:
    """Range, equilibrium and retracement pockets on the last bar of each symbol."""
    fr = _w().rowsBetween(-(lookback - 1), 0)
    g = s.withColumns({"hi": F.coalesce(F.max("swing_high").over(fr), F.max("high").over(fr)),
                       "lo": F.coalesce(F.min("swing_low").over(fr), F.min("low").over(fr))})
    g = g.where((F.col("i") == F.col("n") - 1) & (F.col("n") >= 10) & (F.col("close") > 0) & (F.col("hi") > F.col("lo")))
    rng, px = F.col("hi") - F.col("lo"), F.col("close")
    eq = F.col("lo") + 0.5 * rng
    pos = F.when(F.abs(px - eq) <= eq_band * rng, "equilibrium").when(px > eq, "premium").otherwise("discount")
    return g.select("symbol", "session", "hi", "lo", eq.alias("equilibrium"),
                    (F.col("hi") - deepest * rng).alias("bull_lower"), (F.col("hi") - deep * rng).alias("bull_upper"),
                    (F.col("lo") + deep * rng).alias("bear_lower"), (F.col("lo") + deepest * rng).alias("bear_upper"),
                    pos.alias("position"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px - F.col("lo")) / rng)).alias("pct_of_range"))


def zones(d: DataFrame, s: DataFrame, obs: DataFrame, fvgs: DataFrame, recent: int = 252) -> DataFrame:
    """Merge nearby same-direction pieces into zones, per symbol and direction.

    Pieces in order of their middle: a piece joins the open zone when its middle is within one
    ATR of the previous middle and the zone stays within two ATRs. The fold is sequential, but its
    input is bounded by the bars of one symbol.
    """
    tail = d.where(F.col("i") == F.col("n") - 1).select("symbol", F.col("atr").alias("_a"), F.col("n").alias("_n"), F.col("close").alias("last_price"))
    part = lambda src, kind: src.select("symbol", "direction", "lower", "upper", F.lit(kind).alias("kind"), "session")
    sw = s.join(tail, "symbol").where(F.col("i") >= F.greatest(F.col("_n") - recent, F.lit(0)))
    half = F.col("_a") * 0.5
    lows = sw.where(F.col("swing_low").isNotNull()).select("symbol", F.lit("bullish").alias("direction"), (F.col("swing_low") - half).alias("lower"),
                                                           (F.col("swing_low") + half).alias("upper"), F.lit("swing_low").alias("kind"), "session")
    highs = sw.where(F.col("swing_high").isNotNull()).select("symbol", F.lit("bearish").alias("direction"), (F.col("swing_high") - half).alias("lower"),
                                                             (F.col("swing_high") + half).alias("upper"), F.lit("swing_high").alias("kind"), "session")
    parts = (part(obs, "OB").unionByName(part(fvgs.where(F.col("fill_session").isNull()), "FVG")).unionByName(lows).unionByName(highs))
    g = parts.groupBy("symbol", "direction").agg(F.array_sort(F.array_agg(F.struct(
        ((F.col("lower") + F.col("upper")) / 2).alias("mid"), "lower", "upper", "kind", "session"))).alias("ps")).join(tail, "symbol")
    zone = "struct<lower:double,upper:double,last_mid:double,strength:int,last_touch:date,components:array<string>>"
    empty = F.array().cast(f"array<{zone}>")

    def step(acc: Column, p: Column) -> Column:
        cur = F.element_at(acc, -1)
        lo, hi = F.least(cur["lower"], p["lower"]), F.greatest(cur["upper"], p["upper"])
        joins = (F.size(acc) > 0) & (F.abs(p["mid"] - cur["last_mid"]) <= F.col("_a")) & (hi - lo <= 2 * F.col("_a"))
        fresh = F.struct(p["lower"].alias("lower"), p["upper"].alias("upper"), p["mid"].alias("last_mid"), F.lit(1).alias("strength"),
                         p["session"].alias("last_touch"), F.array(p["kind"]).alias("components")).cast(zone)
        wider = F.struct(lo.alias("lower"), hi.alias("upper"), p["mid"].alias("last_mid"), (cur["strength"] + 1).alias("strength"),
                         F.greatest(cur["last_touch"], p["session"]).alias("last_touch"), F.concat(cur["components"], F.array(p["kind"])).alias("components")).cast(zone)
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(fresh)))

    z = g.withColumn("zs", F.when(F.size("ps") > 0, F.aggregate("ps", empty, lambda acc, p: F.when(
        F.size(acc) == 0, F.array(F.struct(p["lower"].alias("lower"), p["upper"].alias("upper"), p["mid"].alias("last_mid"), F.lit(1).alias("strength"),
                                           p["session"].alias("last_touch"), F.array(p["kind"]).alias("components")).cast(zone))).otherwise(step(acc, p)))))
    z = z.select("symbol", "direction", "last_price", F.inline("zs"))
    h = F.greatest((F.col("upper") - F.col("lower")) / 2, F.lit(1e-6))
    role = (F.when((F.col("direction") == "bullish") & (F.col("last_price") < F.col("lower") - h), "flipped_resistance")
            .when(F.col("direction") == "bullish", "demand")
            .when(F.col("last_price") > F.col("upper") + h, "flipped_support").otherwise("supply"))
    return z.withColumns({"mid": (F.col("lower") + F.col("upper")) / 2, "role": role}).drop("last_mid")


# Weights of the confluence parts and the label limits.
CONFLUENCE_WEIGHTS = {"structure": 0.25, "zone_proximity": 0.20, "recent_fvg": 0.12, "liquidity_sweep": 0.18,
                      "premium_discount": 0.15, "trend_alignment": 0.10}


def confluence(bars: DataFrame) -> DataFrame:
    """Six-part score of the current setup per symbol; symbols with fewer than 30 bars are left out."""
    s = materialize(swings(with_structure_base(bars)), "structure")  # read by all six parts
    d = s
    fv, ob, ev, sp, dr = gaps(d, written=True), order_blocks(d, written=True), structure_events(s), sweeps(s), dealing_range(s)
    zs = zones(d, s, ob, fv)
    last = d.where((F.col("i") == F.col("n") - 1) & (F.col("n") >= 30)).select("symbol", "session", "close", "atr", (F.col("n") - 1).alias("_last"))
    sign = lambda x, up, dn: F.when(F.col(x) == "bullish", up).otherwise(dn)
    age = lambda e: e.join(last.select("symbol", "_last"), "symbol").withColumn("_age", F.col("_last") - F.col("i"))
    tr = ev.groupBy("symbol").agg(F.max_by("direction", F.struct("i", "k")).alias("_trend"))
    w = F.when(F.col("kind") == "CHOCH", 1.0).otherwise(0.6)
    c1 = age(ev).where(F.col("_age") <= 10).groupBy("symbol").agg(
        F.max_by(sign("direction", w, -w), F.struct("i", "k")).alias("structure"))
    # bullish before bearish inside one bar, so the later of the two is the bearish one
    late = F.struct("i", (F.col("direction") == "bearish").cast("int"))
    c3 = age(fv).where((F.col("_age") <= 5) & F.col("fill_session").isNull()).groupBy("symbol").agg(
        F.max_by(sign("direction", F.lit(0.6), F.lit(-0.6)), late).alias("recent_fvg"))
    c4 = age(sp).where(F.col("_age") <= 3).groupBy("symbol").agg(
        F.max_by(sign("direction", F.lit(0.8), F.lit(-0.8)), late).alias("liquidity_sweep"))
    inside = (F.col("lower") <= F.col("close")) & (F.col("close") <= F.col("upper"))
    dist = F.when(inside, 0.0).otherwise(F.least(F.abs(F.col("close") - F.col("lower")), F.abs(F.col("close") - F.col("upper"))))
    z = zs.join(last, "symbol").withColumn("_d", dist).groupBy("symbol").agg(
        F.min_by(F.struct("_d", "direction", "atr"), F.struct("_d", (F.col("direction") == "bearish").cast("int"), "lower")).alias("z"))
    near = (F.col("z.atr") > 0) & (F.col("z._d") <= 0.5 * F.col("z.atr"))
    score = 1.0 - F.col("z._d") / F.greatest(0.5 * F.col("z.atr"), F.lit(TINY))
    c2 = z.where(near).select("symbol", F.when(F.col("z.direction") == "bullish", score).otherwise(-score).alias("zone_proximity"))
    px = dr.join(last.select("symbol", "close"), "symbol")
    c5 = px.select("symbol", F.when(F.col("close").between(F.col("bull_lower"), F.col("bull_upper")), 1.0)
                   .when(F.col("close").between(F.col("bear_lower"), F.col("bear_upper")), -1.0)
                   .when(F.col("position") == "discount", 0.4).when(F.col("position") == "premium", -0.4).otherwise(0.0).alias("premium_discount"))
    c6 = tr.select("symbol", sign("_trend", F.lit(0.4), F.lit(-0.4)).alias("trend_alignment"))
    out = last.select("symbol", "session")
    for c in (c1, c2, c3, c4, c5, c6):
        out = out.join(c, "symbol", "left")
    out = out.fillna(0.0, list(CONFLUENCE_WEIGHTS))
    total = sum((F.col(k) * v for k, v in CONFLUENCE_WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)))
    label = (F.when(F.col("score") > 0.4, "strong_bullish").when(F.col("score") > 0.15, "bullish")
             .when(F.col("score") < -0.4, "strong_bearish").when(F.col("score") < -0.15, "bearish").otherwise("neutral"))
    return out.withColumn("label", label)


def latest(events: DataFrame, k: int, order=("i",)) -> DataFrame:
    """The last ``k`` structures of each symbol (top-k is cut before the shuffle)."""
    w = Window.partitionBy("symbol").orderBy(*[F.desc(x) for x in order])
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
