"""Shared building blocks: full-frame windows, as-of joins, runs, decay averages, ranks, quantiles.

Group sizes. A bar table holds one row per (symbol, session) or (symbol, session, slot), so a
window over one symbol is bounded by the calendar. Anything not bounded that way (ticks, ranks
of a whole cross-section, exact quantiles) takes the blocked forms below: work is cut into
(key, block) pieces, pieces are summarised with mergeable aggregates, and only the summaries
meet per key.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tapegrain.session import materialize, prepare

# A group proven to hold no more rows than this may be handled in one window task.
MAX_GROUP_ROWS = 2_000_000
# Days of three centuries: no bar table holds more rows of one symbol and slot.
CALENDAR_ROWS = 110_000
# exp(+-BLOCK_DECAY) stays far inside the double range.
BLOCK_DECAY = 230.0
N_SPLITS = 256


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_time(keys: str | Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    k = [keys] if isinstance(keys, str) else list(keys)
    o = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*k).orderBy(*o)


def trailing(w: WindowSpec, n: int, end: int = 0) -> WindowSpec:
    """The last ``n`` rows, ending ``end`` rows from the current one."""
    return w.rowsBetween(end - n + 1, end)


def so_far(w: WindowSpec, end: int = 0) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, end)


def full(agg: Column, counted: str | Column, frame: WindowSpec, n: int) -> Column:
    """``agg`` over the frame once the frame holds ``n`` non-null inputs, else null."""
    return F.when(F.count(c(counted)).over(frame) >= n, agg.over(frame))


# Moving sums are taken over their own frame whatever its length: a missing, infinite or huge value
# touches only the rows whose frame holds it, and deviations are centred in the frame.

def roll_sum(x: str | Column, w: WindowSpec, n: int, end: int = 0) -> Column:
    return F.coalesce(F.sum(c(x)).over(trailing(w, n, end)), F.lit(0.0))


def roll_count(x: str | Column, w: WindowSpec, n: int, end: int = 0) -> Column:
    return F.count(c(x)).over(trailing(w, n, end))


def roll_mean(x: str | Column, w: WindowSpec, n: int, end: int = 0, need: int | None = None) -> Column:
    return full(F.avg(c(x)), x, trailing(w, n, end), n if need is None else need)


def roll_cov(x: str | Column, y: str | Column, w: WindowSpec, n: int, need: int | None = None) -> Column:
    """Sample covariance over the frame; x and y must be null on the same rows."""
    k = roll_count(x, w, n)
    return F.when((k >= (n if need is None else need)) & (k > 1), F.covar_samp(c(x), c(y)).over(trailing(w, n)))


def roll_std(x: str | Column, w: WindowSpec, n: int, need: int | None = None) -> Column:
    return full(F.stddev_samp(c(x)), x, trailing(w, n), n if need is None else need)


def roll_moments(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], n: int, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name and its columns (x, y), null on the same rows, over the last ``n`` rows: name_n, name_x (mean of x) and
    name_c (sample covariance; the variance where x is y; null below two rows).

    Linear in the rows at any length: rows are cut into blocks of n, so a frame is the head of its own block and the tail of
    the block before. Both come from running aggregates, one forwards and one backwards, and are merged as parallel moments
    are: nothing is subtracted, and a missing, infinite or huge value touches only the rows whose frame holds it.
    """
    k, o = ([x] if isinstance(x, str) else list(x) for x in (keys, order))
    w = Window.partitionBy(*k).orderBy(*o)
    d = df.withColumn("_b", F.floor((F.row_number().over(w) - 1) / n))
    backwards = Window.partitionBy(*k, F.col("_b")).orderBy(*[F.desc(x) for x in o]).rowsBetween(Window.unboundedPreceding, -1)
    forwards = Window.partitionBy(*k, F.col("_b")).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    parts = lambda x, y, over: F.struct(F.count(x).over(over).alias("n"), F.avg(x).over(over).alias("x"), F.avg(y).over(over).alias("y"), F.covar_pop(x, y).over(over).alias("c"))
    d = d.withColumns({f"_t_{m}": parts(x, y, backwards) for m, (x, y) in pairs.items()})
    d = d.withColumns({f"_t_{m}": F.lag(f"_t_{m}", n).over(w) for m in pairs})
    d = d.withColumns({f"_h_{m}": parts(x, y, forwards) for m, (x, y) in pairs.items()})
    out: dict[str, Column] = {}
    for m in pairs:
        h, t = F.col(f"_h_{m}"), F.col(f"_t_{m}")
        a, b = h["n"], F.coalesce(t["n"], F.lit(0))
        both, total = (a > 0) & (b > 0), F.nullif(a + b, F.lit(0))
        mean = F.when(both, h["x"] + (t["x"] - h["x"]) * b / total).otherwise(F.coalesce(F.when(a > 0, h["x"]), t["x"]))
        moment = F.coalesce(a * h["c"], F.lit(0.0)) + F.coalesce(b * t["c"], F.lit(0.0)) + F.when(both, (t["x"] - h["x"]) * (t["y"] - h["y"]) * a * b / total).otherwise(0.0)
        out |= {f"{m}_n": a + b, f"{m}_x": mean, f"{m}_c": F.when(a + b > 1, moment / (a + b - 1))}
    return d.withColumns(out).drop("_b", *[f"_{s}_{m}" for s in "th" for m in pairs])


def ratio(a: str | Column, b: str | Column) -> Column:
    return c(a) / F.nullif(c(b), F.lit(0.0))


def clip(x: str | Column, lo: float, hi: float) -> Column:
    return F.when(c(x).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c(x))))


# --- as-of ------------------------------------------------------------------------------------

def asof_join(left: DataFrame | None, right: DataFrame, key: str | Sequence[str], left_ts: str,
              right_ts: str, values: dict[str, str], direction: str = "backward",
              allow_equal: bool = True, block: str | None = None, carried: str | None = None) -> DataFrame:
    """Attach to each left row the nearest right row before (or after) it.

    ``values`` maps right columns to output names. ``block`` is a SQL expression over ``_t``
    (the time column) that cuts hot keys into pieces; leave it out only where the calendar
    bounds the rows per key. Linear: one shuffle (blocked form: one more over summaries).

    ``carried`` names an array column of ``right`` that holds, as structs, the left rows made from each right row; ``left`` is then
    None. A union forgets how its sides are dealt; rows that open their arrays do not, so a series that looks itself up is not shuffled.
    """
    prepare(right.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    if (left is None) != (carried is not None) or (carried and block):
        raise ValueError("either left rows or a carried column, and that without blocks")
    back = direction == "backward"
    # right rows sort first when they may match at equal time, last when they may not
    r_first = allow_equal
    l_rank, r_rank = (1, 0) if r_first else (0, 1)
    payload = F.struct(*[F.col(a).alias(b) for a, b in values.items()])
    if carried:
        kind, value = right.schema[carried].dataType.elementType, right.select(payload.alias("_r")).schema["_r"].dataType
        time = right.schema[right_ts].dataType
        lcols = [*keys, *kind.names]
        none = F.array().cast(ArrayType(StructType().add("_t", time).add("_k", "integer").add("_l", kind).add("_r", value)))
        own = F.when(F.col(right_ts).isNotNull(), F.array(F.struct(F.col(right_ts).alias("_t"), F.lit(r_rank).alias("_k"), F.lit(None).cast(kind).alias("_l"), payload.alias("_r"))))
        asks = F.transform(carried, lambda z: F.struct(z[left_ts].cast(time).alias("_t"), F.lit(l_rank).alias("_k"), z.alias("_l"), F.lit(None).cast(value).alias("_r")))
        u = right.select(*keys, F.explode(F.concat(F.coalesce(own, none), F.coalesce(asks, none))).alias("_z")).select(*keys, "_z._t", "_z._k", "_z._l", "_z._r")
    else:
        lcols = left.columns
        lhs = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(l_rank).alias("_k"),
                          F.struct(*[F.col(x) for x in lcols]).alias("_l"))
        rhs = (right.where(F.col(right_ts).isNotNull())
               .select(*keys, F.col(right_ts).alias("_t"), F.lit(r_rank).alias("_k"), payload.alias("_r")))
        u = lhs.unionByName(rhs, allowMissingColumns=True)
    order = [F.col("_t").asc(), F.col("_k").asc()] if back else [F.col("_t").desc(), F.col("_k").asc()]
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        hit = u.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    else:
        u = u.withColumn("_b", F.expr(block))
        w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        pick = F.max_by if back else F.min_by
        ends = u.groupBy(*keys, "_b").agg(
            pick("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_e"))
        b_order = F.col("_b").asc() if back else F.col("_b").desc()
        wb = Window.partitionBy(*keys).orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(*keys, "_b", F.last("_e", ignorenulls=True).over(wb).alias("_c"))
        local = u.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
        hit = local.join(carry, [*keys, "_b"], "left").withColumn("_r", F.coalesce("_r", "_c"))
    from_left = [F.col(x) if carried and x in keys else F.col("_l")[x].alias(x) for x in lcols]
    return hit.select(*from_left, *[F.col("_r")[b].alias(b) for b in values.values()])



# --- running aggregates over hot keys -----------------------------------------------------------

def blocked_running_sum(df: DataFrame, key: str | Sequence[str], order: Sequence[str], block: str,
                        sums: dict[str, str]) -> DataFrame:
    """Running sums per key when one key may hold a large share of all rows.

    ``block`` is a column that does not decrease along ``order``. Local running sums are taken
    per (key, block); block totals, one row each, carry the sums of the earlier blocks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, block).agg(*[F.sum(x).alias(o) for x, o in sums.items()])
    wb = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, block, *[F.coalesce(F.sum(o).over(wb), F.lit(0)).alias(f"_c_{o}")
                                          for o in sums.values()])
    out = df.join(carry, [*keys, block])
    return out.select(*df.columns, *[(F.sum(x).over(w) + F.col(f"_c_{o}")).alias(o)
                                     for x, o in sums.items()])


# --- runs ---------------------------------------------------------------------------------------

def with_run(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], label: str,
             out: str = "run") -> DataFrame:
    """Number the consecutive runs of one label (null is a label of its own)."""
    w = by_time(keys, order)
    prev = F.lag(label).over(w)
    first = F.row_number().over(w) == 1
    flag = F.when(first | ~F.col(label).eqNullSafe(prev), 1).otherwise(0)
    return (df.withColumn("_chg", flag)
            .withColumn(out, F.sum("_chg").over(so_far(w))).drop("_chg"))


def latch(on: Column, off: Column, w: WindowSpec) -> Column:
    """On at one threshold, off at another; on and off never hold together. False before either."""
    state = F.when(on, F.lit(True)).when(off, F.lit(False))
    return F.coalesce(F.last(state, ignorenulls=True).over(so_far(w)), F.lit(False))


def confirm(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], raw: str, days: int,
            immediate: Sequence[str] = (), out: str = "regime") -> DataFrame:
    """Adopt a new label only after ``days`` equal raw labels in a row; some labels at once.

    The first label of a series is adopted at once and null rows are skipped.
    """
    w = by_time(keys, order)
    live = F.col(raw).isNotNull()
    # live rows are numbered, and a run starts where the label is not that of the live row before, all in the one order of the series
    d = df.withColumns({"_n": F.count(raw).over(so_far(w)), "_prev": F.last(raw, ignorenulls=True).over(so_far(w, -1))})
    start = F.when(live & ((F.col("_n") == 1) | ~F.col(raw).eqNullSafe(F.col("_prev"))), F.col("_n"))
    d = d.withColumn("_start", F.last(start, ignorenulls=True).over(so_far(w)))
    ok = live & ((F.col("_n") == 1) | (F.col("_n") - F.col("_start") + 1 >= days) | F.col(raw).isin(list(immediate)))
    d = d.withColumn("_adopt", F.when(ok, F.col(raw)))
    return d.withColumn(out, F.last("_adopt", ignorenulls=True).over(so_far(w))).drop("_n", "_prev", "_start", "_adopt")


# --- exponentially weighted means ---------------------------------------------------------------

def ewm(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str],
        specs: dict[str, tuple[str, float, int]], clock: str | None = None) -> DataFrame:
    """Recursive decay averages ``y = (1-a) y' + a x`` as window sums.

    ``specs`` maps an output name to (input, alpha, min_periods). The first non-null input
    starts the recursion; at a null input the value is carried and the old weight keeps
    decaying, so the next input meets ``b^gap``. Every step is affine, hence

        y_t = exp(L_t) * sum(d_s * exp(-L_s)),   L = running sum of the log step factors.

    Inputs that are null on the same rows can share one ``clock`` column and then, for equal
    alpha, all windows but the last.
    """
    w = by_time(keys, order)
    run = so_far(w)
    k = [keys] if isinstance(keys, str) else list(keys)
    o = [order] if isinstance(order, str) else list(order)
    clocks = {out: clock or x for out, (x, _, _) in specs.items()}
    d = df.withColumn("_i", F.row_number().over(w)).withColumns({f"_n_{x}": F.count(x).over(run) for x in set(clocks.values())})
    d = d.withColumns({f"_g_{x}": F.col("_i") - F.last(F.when(F.col(x).isNotNull(), F.col("_i")), ignorenulls=True).over(so_far(w, -1))
                       for x in set(clocks.values())})
    groups: dict[tuple[str, float], list[str]] = {}
    for out, (_, a, _) in specs.items():
        groups.setdefault((clocks[out], a), []).append(out)
    steps, inputs = {}, {}
    scans = []
    for i, ((x, a), outs) in enumerate(groups.items()):
        live, start = F.col(x).isNotNull(), F.col(f"_n_{x}") == 1
        old = F.pow(F.lit(1.0 - a), F.col(f"_g_{x}"))
        steps[f"_s_{i}"] = F.when(~live | start, F.lit(0.0)).otherwise(F.log(old / (old + a)))
        for out in outs:
            v = F.col(specs[out][0])
            inputs[f"_d_{out}"] = F.when(live & start, v).when(live, v * a / (old + a)).otherwise(F.lit(0.0))
        scans.append((f"_s_{i}", {f"_v_{out}": f"_d_{out}" for out in outs}))
    d = affine_scan(d.withColumns({**steps, **inputs}), k, o, scans)
    d = d.withColumns({out: F.when(F.col(f"_n_{clocks[out]}") >= mp, F.col(f"_v_{out}")) for out, (_, _, mp) in specs.items()})
    return d.drop("_i", *[f"_{p}_{x}" for x in clocks.values() for p in "ng"], *steps, *inputs, *[f"_v_{out}" for out in specs])


def affine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                scans: Sequence[tuple[str, dict[str, str]]]) -> DataFrame:
    """y_t = exp(s_t) y_{t-1} + d_t for log factors s <= 0; ``scans``: (s column, {output: d column}).

    Rows are cut where the running sum of s has fallen by BLOCK_DECAY; one block back already
    weighs exp(-230), so a block needs only the end value of the block before it. Blocks follow
    the order, so all windows of one scan share one sort.
    """
    k, o = list(keys), list(order)
    w = Window.partitionBy(*k).orderBy(*o)
    d = df.withColumns({f"_L{i}": F.sum(s).over(so_far(w)) for i, (s, _) in enumerate(scans)})
    d = d.withColumns({f"_b{i}": F.floor(-F.col(f"_L{i}") / BLOCK_DECAY) for i in range(len(scans))})
    d = d.withColumns({f"_M{i}": F.col(f"_L{i}") + F.col(f"_b{i}") * F.lit(BLOCK_DECAY) for i in range(len(scans))})
    for i, (_, outs) in enumerate(scans):
        wb = so_far(Window.partitionBy(*k, f"_b{i}").orderBy(*o))
        wk = Window.partitionBy(*k).orderBy(f"_b{i}", *o)
        d = d.withColumns({f"_y{out}": F.exp(f"_M{i}") * F.sum(F.col(x) * F.exp(-F.col(f"_M{i}"))).over(wb) for out, x in outs.items()})
        # the end of the block before, noted at a block's first row and kept by wk: over wb, Spark moves windows by the keys alone
        # beneath it and sorts twice more
        ends = F.struct(F.lag(f"_L{i}").over(wk).alias("L"), *[F.lag(f"_y{out}").over(wk).alias(out) for out in outs])
        d = d.withColumn("_p", F.when(~F.col(f"_b{i}").eqNullSafe(F.lag(f"_b{i}").over(wk)), ends))
        d = d.withColumn("_e", F.last("_p", ignorenulls=True).over(so_far(wk)))
        d = d.withColumns({out: F.col(f"_y{out}") + F.when(F.col(f"_b{i}") > 0, F.col("_e")[out] * F.exp(F.col(f"_L{i}") - F.col("_e")["L"])).otherwise(0.0) for out in outs})
        d = d.drop("_p", "_e", f"_L{i}", f"_b{i}", f"_M{i}", *[f"_y{out}" for out in outs])
    return d


# --- ranks and quantiles of whole cross-sections ------------------------------------------------

def rank_in_group(df: DataFrame, by: Sequence[str], value: str, out: str = "pct",
                  bound: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Percentile rank with averaged ties, centred at 0; null values stay null.

    ``bound`` is a proven upper limit of rows per group (for a date: the number of symbols).
    Up to MAX_GROUP_ROWS one window does it. Beyond, or without a bound, groups are cut at approximate
    quantiles, and offsets of the pieces make the ranks exact whatever the cut points are. The rows are
    shuffled once; values that fill a piece of their own take their rank from the counts. ``source``, where
    given, holds the same groups and values in fewer steps; the counts are read from it.
    """
    by = list(by)
    if bound is not None and bound <= MAX_GROUP_ROWS:
        w = Window.partitionBy(*by)
        lt = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
        return df.withColumn(out, F.when(F.col(value).isNotNull(),
                                         (lt + (ties - 1) / 2.0) / F.count(value).over(w) - 0.5))
    cuts = _cuts(df if source is None else source, by, value)
    d = df.join(cuts, by, "left") if by else df.join(F.broadcast(cuts))
    d = _piece(d, value).withColumn("_pz", F.get("_at", F.col("_pc"))).drop("_pc")
    d = d.select(*df.columns, "_all", "_pz.*")
    # rows that equal a cut have their rank from the counts and stay dealt as they were, however many they are
    d = d.withColumn("_ps", F.when(F.col("_pc").isNull() | (F.col("_pc") % 2 == 1), F.spark_partition_id()).otherwise(-1))
    w = Window.partitionBy(*by, "_pc", "_ps")
    within = F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "_pc", "_ps", value)) - 1) / 2.0
    rank = F.col("_off") + F.when(F.col("_pc") % 2 == 1, (F.col("_cnt") + 1) / 2.0).otherwise(within)
    return d.withColumn(out, F.when(F.col(value).isNotNull(), rank / F.col("_all") - 0.5)).drop("_all", "_pc", "_off", "_cnt", "_ps")


def _piece(d: DataFrame, v: str) -> DataFrame:
    """With ``_pc``: 2 k where k of the cut points ``_sp`` lie below the value, one more where the value is the next; null for null."""
    d = d.withColumn("_pc", F.lit(0))
    for i in reversed(range((N_SPLITS - 1).bit_length())):  # a step of a search in each column, so that none is computed twice
        d = d.withColumn("_pc", F.col("_pc") + F.when(F.get("_sp", F.col("_pc") + (2 ** i - 1)) < F.col(v), 2 ** i).otherwise(0))
    return d.withColumn("_pc", F.when(F.col(v).isNotNull(), 2 * F.col("_pc") + F.coalesce(F.get("_sp", F.col("_pc")) == F.col(v), F.lit(False)).cast("int")))


def _cuts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A row for each group: its count ``_all``, cut points, and for each piece between or on them (_pc, _off, _cnt), the values below it and in it.

    Written, as the cut points are approximate and may differ from run to run; it does not grow with the rows."""
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    sp = v.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", [i / N_SPLITS for i in range(1, N_SPLITS)], 4 * N_SPLITS)).alias("_sp"), F.count(F.lit(1)).alias("_all"))
    sp = materialize(sp, "cuts")
    held = _piece(v.join(sp, by) if by else v.join(F.broadcast(sp)), "_v").groupBy(*by, "_pc").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_pc").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    held = held.groupBy(*by).agg(F.map_from_entries(F.array_agg(F.struct("_pc", F.struct("_pc", "_off", "_cnt")))).alias("_m"))
    at = F.transform(F.sequence(F.lit(0), 2 * F.size("_sp")), lambda i: F.try_element_at("_m", i))
    return materialize((sp.join(held, by) if by else sp.join(F.broadcast(held))).withColumn("_at", at).drop("_m"), "cuts")


def _counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values per group with their count and the exact running count."""
    vc = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"))
          .agg(F.count(F.lit(1)).alias("_c")))
    cuts = [i / N_SPLITS for i in range(1, N_SPLITS)]
    sp = vc.groupBy(*by).agg(F.percentile_approx("_v", cuts, 4 * N_SPLITS).alias("_sp"), F.sum("_c").alias("_n"))
    b = vc.join(sp, by) if by else vc.join(F.broadcast(sp))  # without keys: one row
    # cut points below the value, found in two steps: every 16th first, then the 16 after it
    below = lambda a: F.size(F.filter(a, lambda s: s < F.col("_v")))
    b = b.withColumn("_k", below(F.transform(F.sequence(F.lit(16), F.size("_sp"), F.lit(16)), lambda i: F.element_at("_sp", i))))
    b = b.withColumn("_b", F.col("_k") * 16 + below(F.slice("_sp", F.col("_k") * 16 + 1, F.lit(16)))).drop("_sp", "_k")
    # the cut points are approximate and may differ from run to run, so pieces and their offsets must read the same ones
    b = materialize(b, "pieces")
    tot = b.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc"))
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "_b", F.coalesce(F.sum("_bc").over(wb), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (b.join(off, [*by, "_b"])
            .withColumn("_cum", F.col("_off") + F.sum("_c").over(w)))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], bound: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    ``bound`` is a proven limit of rows per group (for one symbol: the days of the calendar); within
    MAX_GROUP_ROWS one aggregate does it. Without it groups may have any size.
    """
    by = list(by)
    if bound is not None and bound <= MAX_GROUP_ROWS:
        return df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])
    cum = _counted(df, by, value)
    aggs = []
    for name, p in probs.items():
        h = F.lit(p) * (F.col("_n") - 1)
        inside = lambda k: (F.col("_cum") - F.col("_c") <= k) & (k < F.col("_cum"))
        aggs += [F.max(F.when(inside(F.floor(h)), F.col("_v"))).alias(f"_lo_{name}"),
                 F.max(F.when(inside(F.ceil(h)), F.col("_v"))).alias(f"_hi_{name}"),
                 F.max(h - F.floor(h)).alias(f"_f_{name}")]
    g = cum.groupBy(*by).agg(*aggs)
    return g.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
                           for n in probs])


# --- order statistics of moving frames ----------------------------------------------------------

def _frames(frame: int, names: list[str], median: tuple[str, int] | None, below: tuple[str, int] | None):
    """Order statistics of one block of ``frame`` rows, given the block before it."""
    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("_n", "ascending")])).combine_chunks()
        own = group.column("_own").to_numpy()
        x = group.column("_x").to_numpy()  # null reads as NaN
        held: list[float] = []  # the frame's values, ascending
        medians, shares = np.full(len(x), np.nan), np.full(len(x), np.nan)
        start = int(np.argmax(own)) if own.any() else len(x)
        for i, v in enumerate(x.tolist()):
            if i >= start and median:  # rows i - frame to i - 1
                n = len(held)
                if n and n >= median[1]:
                    medians[i] = held[n // 2] if n % 2 else (held[n // 2 - 1] + held[n // 2]) / 2
            if median is None and i >= frame and x[i - frame] == x[i - frame]:
                del held[bisect.bisect_left(held, x[i - frame])]
            if v == v:
                bisect.insort(held, v)
            if i >= start and below and v == v:  # rows i - frame + 1 to i
                rows = min(i + 1, frame)
                if len(held) >= below[1] and rows > 1:
                    shares[i] = bisect.bisect_left(held, v) / (rows - 1)
            if median and i >= frame and x[i - frame] == x[i - frame]:
                del held[bisect.bisect_left(held, x[i - frame])]
        out = dict(zip(names, group.filter(pa.array(own)).select(names).columns))
        for spec, values in ((median, medians), (below, shares)):
            if spec:
                out[spec[0]] = pa.array(values[own], pa.float64(), from_pandas=True)
        return pa.table(out)
    return run


def moving_order(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], x: str, frame: int,
                 median: tuple[str, int] | None = None, below: tuple[str, int] | None = None) -> DataFrame:
    """Order statistics of ``x`` over moving frames: either ``median`` (name, least values) of the ``frame`` rows before
    each row, or ``below`` (name, least values), the share of the other rows of the frame that ends with the row that lie strictly
    under its value. Rows without a value count in that share's base only; null where values are too few.

    Rows are numbered and cut into blocks of ``frame``. A frame reaches into one earlier block, so each block is worked on with
    the values of the one before it: an ordered list gains and loses one value a row, a search each. Work grows with
    rows times log(frame), and no row carries its frame.
    """
    if (median is None) == (below is None):
        raise ValueError("one of median and below")
    k, o = ([c] if isinstance(c, str) else list(c) for c in (keys, order))
    n = (F.row_number().over(Window.partitionBy(*k).orderBy(*o)) - 1).cast("long")
    d = df.withColumns({"_n": n, "_x": F.nanvl(F.col(x).cast("double"), F.lit(None))} | {f"_k{i}": F.col(c) for i, c in enumerate(k)})
    block = F.floor(F.col("_n") / frame)
    d = d.withColumn("_c", F.explode(F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own")))))
    own = F.col("_c.own")
    d = d.select(*[F.when(own, F.col(c)).alias(c) for c in df.columns], *[f"_k{i}" for i in range(len(k))], "_n", "_x", F.col("_c.b").alias("_b"), own.alias("_own"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return d.groupBy(*[f"_k{i}" for i in range(len(k))], "_b").applyInArrow(_frames(frame, df.columns, median, below), f"{schema}, `{(median or below)[0]}` double")


# --- seeded draws -------------------------------------------------------------------------------

_P = 2147483647  # a prime; all products below stay under 2^62


def uniform(seed: int, *ids: Column) -> Column:
    """A repeatable draw in [0, 1) per id tuple: modular squaring, plain integer arithmetic."""
    h: Column = F.lit(seed % _P).cast("bigint")
    for i, x in enumerate(ids):
        h = (h * 48271 + F.pmod(x.cast("bigint"), F.lit(_P)) * (69621 + 2 * i) + 12345) % _P
        h = (h * h + h * 16807 + 7) % _P
    h = (h * h + 3 * h + 11) % _P
    return h.cast("double") / _P


def uniform_sql(seed: int, *ids: str) -> str:
    """The same draw as DuckDB text."""
    h = f"CAST({seed % _P} AS BIGINT)"
    for i, x in enumerate(ids):
        h = f"(({h} * 48271 + (CAST({x} AS BIGINT) % {_P}) * {69621 + 2 * i} + 12345) % {_P})"
        h = f"list_transform([{h}], lambda z: (z * z + z * 16807 + 7) % {_P})[1]"
    return f"(list_transform([{h}], lambda z: (z * z + 3 * z + 11) % {_P})[1] / CAST({_P} AS DOUBLE))"


def _poisson_steps() -> list[float]:
    """Distribution function of Poisson(1) until it is 1 in double precision."""
    cum, p, steps = 0.0, math.exp(-1), []
    while cum + p > cum and cum < 1:
        cum += p
        steps.append(cum)
        p /= len(steps)
    return steps


def poisson_one(u: Column) -> Column:
    """Poisson(1) count from a uniform draw (inverse distribution function)."""
    steps = _poisson_steps()
    out = F.lit(len(steps))
    for k in range(len(steps) - 1, -1, -1):
        out = F.when(u < steps[k], F.lit(k)).otherwise(out)
    return out.cast("double")


def poisson_one_sql(u: str) -> str:
    steps = _poisson_steps()
    return f"CAST(CASE {' '.join(f'WHEN {u} < {x!r} THEN {k}' for k, x in enumerate(steps))} ELSE {len(steps)} END AS DOUBLE)"
