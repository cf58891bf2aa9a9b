"""Entry set-ups on intraday bars and position rules on daily bars, each as one plan for all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.functions import indicators as I
from tapegrain.operators.kernels import by_time, latch, so_far


def minute(clock: str) -> int:
    h, m = clock.split(":")
    return 60 * int(h) + int(m)


# Minutes of the day between which a bar may close with a signal (fixed values).
SIGNAL_FROM, SIGNAL_TO = "10:00", "15:30"


@dataclass(frozen=True)
class Setup:
    """When a set-up may fire and how its trade is managed; distances in daily ranges, sessions 0 ends at the close."""
    sessions: int
    stop: float | None = None
    least_stop: float | None = None
    most_stop: float | None = None
    target: float | None = None
    trail_after: float | None = None
    trail: float | None = None
    begin: str = SIGNAL_FROM
    end: str = SIGNAL_TO
    day_before: bool = False
    bounds: tuple[tuple[str, float], ...] = ()

    def __getitem__(self, name: str) -> float:
        return dict(self.bounds)[name]


# The set-ups and their bounds (fixed values).
SETUPS = {
    "pullback": Setup(10, stop=1.5, target=3.0, trail_after=1.5, trail=1.5, day_before=True, bounds=(("rsi", 30.0),)),
    "vwap_reversion": Setup(5, stop=2.5, day_before=True, bounds=(("rsi", 10.0), ("stretch", 0.5))),
    "compression_breakout": Setup(10, stop=1.5, target=3.0, trail_after=1.5, trail=2.0, day_before=True, bounds=(("width_rank", 0.20), ("relvol", 1.2))),
    "gap_go": Setup(5, least_stop=0.5, most_stop=1.5, target=2.0, trail_after=1.0, trail=1.0, end="11:30", day_before=True, bounds=(("gap", 0.5), ("relvol", 1.5))),
    "gap_fade_down": Setup(0, stop=1.5, begin="10:30", end="14:30", bounds=(("gap", 0.5), ("relvol", 1.5))),
    "liquidity_sweep": Setup(0, least_stop=0.25, most_stop=1.0, end="14:30", bounds=(("buffer", 0.1),)),
    "last_half_hour": Setup(0, stop=0.5, begin="15:30"),
    "orb30": Setup(0, least_stop=0.25, most_stop=1.0, end="12:00", bounds=(("relvol", 1.2),)),
}


def context(bars: DataFrame, daily: DataFrame, regimes: DataFrame | None = None) -> DataFrame:
    """Intraday features (``regimes.intraday_features``, with a column ``mod``, the minute at which a bar closes) beside
    yesterday's daily features (``strategies.lagged_features``) and regime, and what the session has shown so far."""
    x = bars.join(daily, ["symbol", "session"], "left")
    if regimes is None:
        x = x.withColumn("regime_y", F.lit(None).cast("string"))
    else:
        known = regimes.select("symbol", "session", F.lag("regime").over(by_time("symbol", "session")).alias("regime_y"))
        x = x.join(known, ["symbol", "session"], "left")
    if "tr_factor_bar" not in x.columns:
        x = x.withColumn("tr_factor_bar", F.lit(1.0))
    whole, order = Window.partitionBy("symbol", "session"), Window.partitionBy("symbol", "session").orderBy("ts")
    opening = F.col("slot") <= 1
    return x.withColumns({
        "range_exec": F.col("atr_prev") / F.col("tr_factor_bar"), "near_close": F.col("slot") == F.max("slot").over(whole) - 1,
        "was_below": F.coalesce(F.max(F.col("close") < F.col("vwap_s")).over(so_far(order, -1)), F.lit(False)),
        "first_close": F.max(F.when(F.col("mod") == minute(SIGNAL_FROM), F.col("close"))).over(whole),
        "opening_high": F.max(F.when(opening, F.col("high"))).over(whole), "opening_low": F.min(F.when(opening, F.col("low"))).over(whole)})


def _rules(last_half_hour: Column) -> dict[str, tuple[Column, Column, Column | None, Column]]:
    """For each set-up: what held yesterday, what triggers now, the level a stop lies under, and the score."""
    c, s = F.col, SETUPS
    true = F.lit(True)
    below_low = c("low_y")
    return {
        "pullback": ((c("regime_y") == "bull") & (c("rsi_3_y") <= s["pullback"]["rsi"]), (c("close") > c("vwap_s")) & c("was_below"), None, -c("rsi_3_y")),
        "vwap_reversion": ((c("close_y") > c("sma200_y")) & (c("rsi_2_y") <= s["vwap_reversion"]["rsi"]), c("dist") <= -s["vwap_reversion"]["stretch"], None, -c("rsi_2_y")),
        "compression_breakout": ((c("bw_rank_y") <= s["compression_breakout"]["width_rank"]) & (c("close_y") > c("sma50_y")),
                                 (c("close") > c("high20_y")) & (c("relvol") >= s["compression_breakout"]["relvol"]), None, c("relvol")),
        "gap_go": ((c("close_y") > c("sma50_y")) & (c("sma50_slope_y") > 0) & (c("gap") >= s["gap_go"]["gap"]),
                   (c("close") > c("open_d")) & (c("close") > c("vwap_s")) & (c("relvol") >= s["gap_go"]["relvol"]), c("sess_low"), c("gap")),
        "gap_fade_down": (true, (c("gap") <= -s["gap_fade_down"]["gap"]) & (c("close") < c("open_d")) & (c("close") < c("vwap_s")) & (c("relvol") >= s["gap_fade_down"]["relvol"]), None, -c("gap")),
        "liquidity_sweep": (true, (c("sess_low") < below_low) & (c("close") > below_low), c("sess_low") - s["liquidity_sweep"]["buffer"] * c("atr_prev"), (below_low - c("sess_low")) / c("atr_prev")),
        "last_half_hour": (last_half_hour, c("first_close") > c("prev_close"), None, c("first_close") / c("prev_close") - 1),
        "orb30": (true, (c("slot") >= 2) & (c("close") > c("opening_high")) & (c("relvol") >= s["orb30"]["relvol"]), c("opening_low"), c("relvol")),
    }


def setups(x: DataFrame, last_half_hour: Column) -> DataFrame:
    """(symbol, session, ts, setup, entry, setup_entry, exit_moc, distances, max_sessions, score) of every bar on which
    a set-up fires: its first trigger of the session, its plain entry at the start of the signal window, or its exit into the close.

    ``x`` is the table of ``context``; ``last_half_hour`` tells which symbols that set-up may trade. All set-ups are
    worked out beside each other in one pass over the session, then stacked.
    """
    order = Window.partitionBy("symbol", "session").orderBy("ts")
    never, none, now = F.lit(False), F.lit(None).cast("double"), F.col("mod")
    flags, rows = {}, []
    for name, (before, trigger, floor, score) in _rules(last_half_hour).items():
        s = SETUPS[name]
        on = F.coalesce(before & trigger & now.between(minute(s.begin), minute(s.end)), never)
        flags[f"_on_{name}"] = on
        stop = s.stop * F.col("range_exec") if s.stop else F.least(F.greatest((F.col("close") - floor) / F.col("tr_factor_bar"), s.least_stop * F.col("range_exec")), s.most_stop * F.col("range_exec"))
        far = lambda k: none if k is None else k * F.col("range_exec")
        plain = F.coalesce(before & (now == minute(SIGNAL_FROM)), never) if s.day_before else never
        leave = F.coalesce(F.col("near_close") & (F.col("close") > (F.col("sum4_y") + F.col("close")) / 5), never) if name == "vwap_reversion" else never
        rows.append(F.struct(F.lit(name).alias("setup"), (F.col(f"_on_{name}") & (F.col(f"_k_{name}") == 1)).alias("entry"), plain.alias("setup_entry"), leave.alias("exit_moc"), stop.alias("stop_dist"),
                             far(s.target).alias("target_dist"), far(s.trail_after).alias("trail_after"), far(s.trail).alias("trail_dist"), F.lit(s.sessions).alias("max_sessions"), score.alias("score")))
    d = x.withColumns(flags)
    d = d.withColumns({f"_k_{n}": F.sum(F.col(f"_on_{n}").cast("int")).over(so_far(order)) for n in SETUPS})
    return d.select("symbol", "session", "ts", F.explode(F.array(*rows)).alias("z")).select("symbol", "session", "ts", "z.*").where("entry or setup_entry or exit_moc")


# --- position rules -----------------------------------------------------------------------------

# Kinds of position rules with the defaults of their parameters (fixed values).
POSITION_RULES: dict[str, dict[str, float]] = {
    "buy_and_hold": {},
    "sma_cross": {"fast": 12, "slow": 26},
    "rsi": {"period": 14, "buy_below": 30, "sell_above": 70},
    "macd_cross": {},
}
#: Rules that one plan takes; a longer table is to be split.
MAX_RULES = 2000


def rule_positions(bars: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, symbol, session, position): 1 while a rule is long, else 0, for every rule and bar.

    ``rules`` holds one rule a row: rule_id, kind, params (map of names to numbers; missing ones take their defaults). The rules
    are compiled to columns over the same windows: an indicator that several rules use is computed once, a rule with
    separate thresholds for on and off holds its state by a latch, and the bars are shuffled once for all rules.
    """
    held = rules.select("rule_id", "kind", "params").orderBy("rule_id").limit(MAX_RULES + 1).collect()  # a table of parameters
    if len(held) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    d, have, w = bars.select("symbol", "session", "close"), set(), by_time("symbol", "session")
    position: dict[str, Column] = {}

    def need(name: str, add) -> str:
        nonlocal d
        if name not in have:
            d = add(d)
            have.add(name)
        return name

    for r in held:
        if r["kind"] not in POSITION_RULES:
            raise ValueError(f"unsupported kind of rule: {r['kind']}")
        p = POSITION_RULES[r["kind"]] | (r["params"] or {})
        odd = set(p) - set(POSITION_RULES[r["kind"]])
        if odd:
            raise ValueError(f"{r['kind']} has no {', '.join(sorted(odd))}")
        if r["kind"] == "buy_and_hold":
            long = F.lit(True)
        elif r["kind"] == "sma_cross":
            fast, slow = (need(f"sma_{int(p[k])}", lambda d, n=int(p[k]): I.add_sma(d, n)) for k in ("fast", "slow"))
            long = F.col(fast) > F.col(slow)
        elif r["kind"] == "macd_cross":
            need("macd", I.add_macd)
            long = F.col("macd") > F.col("macd_signal")
        else:
            rsi = need(f"rsi_{int(p['period'])}", lambda d, n=int(p["period"]): I.add_rsi(d, n))
            # of a bar that is under one threshold and over the other the sale counts, as it is looked at last
            on, off = F.col(rsi) < p["buy_below"], F.col(rsi) > p["sell_above"]
            long = latch(on & ~F.coalesce(off, F.lit(False)), off, w)
        position[r["rule_id"]] = F.coalesce(long, F.lit(False)).cast("int")
    if not position:
        return d.limit(0).select(F.lit(None).cast(rules.schema["rule_id"].dataType).alias("rule_id"), "symbol", "session", F.lit(0).alias("position"))
    d = d.withColumns({f"_p{i}": x for i, x in enumerate(position.values())})
    stacked = F.array(*[F.struct(F.lit(k).cast(rules.schema["rule_id"].dataType).alias("rule_id"), F.col(f"_p{i}").alias("position")) for i, k in enumerate(position)])
    return d.select("symbol", "session", F.explode(stacked).alias("z")).select("z.rule_id", "symbol", "session", "z.position")
