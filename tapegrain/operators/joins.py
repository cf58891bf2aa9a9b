"""Point-in-time joins: intervals, events to sessions, trailing ranges, nearest rows, reconciliation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import asof_join, by_time, so_far
from tapegrain.session import materialize


def members_on(rows: DataFrame, intervals: DataFrame, key: str, day: str) -> DataFrame:
    """Rows whose key is inside one of its valid-time intervals on that day (open end = null)."""
    iv = intervals.select(F.col(key), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col(day) >= F.col("_s")) & (F.col("_e").isNull() | (F.col(day) <= F.col("_e")))
    return rows.join(iv, key).where(on).drop("_s", "_e")


def members_between(rows: DataFrame, intervals: DataFrame, key: str, day: str, carry: Sequence[str] = ()) -> DataFrame:
    """As ``members_on`` but carries interval columns such as the entity key."""
    iv = intervals.select(F.col(key), F.col("start").alias("_s"), F.col("end").alias("_e"), *carry)
    on = (F.col(day) >= F.col("_s")) & (F.col("_e").isNull() | (F.col(day) <= F.col("_e")))
    return rows.join(iv, key).where(on).drop("_s", "_e")


def with_session_after(rows: DataFrame, calendar: DataFrame, day: Column, out: str, strict: bool = False) -> DataFrame:
    """First session on or after (or strictly after) a date.

    The calendar is turned into one row per date, bounded by time, and joined by equality.
    """
    c = calendar.select("session")
    span = c.agg(F.min("session").alias("a"), F.max("session").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("_d"))
    back = Window.partitionBy().orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    m = days.join(c, days._d == c.session, "left").select("_d", F.last("session", ignorenulls=True).over(back).alias(out))
    first = c.agg(F.min("session").alias("_first"))
    r = rows.withColumn("_d", day).join(F.broadcast(m), "_d", "left").join(F.broadcast(first))
    return r.withColumn(out, F.when(F.col("_d") < F.col("_first"), F.col("_first")).otherwise(F.col(out))).drop("_d", "_first")


def reaction_sessions(events: DataFrame, calendar: DataFrame, day: str, timing: str) -> DataFrame:
    """Event -> session(s) that react: before the open the same or next session, after the close the
    next one, unknown timing both."""
    e = with_session_after(events, calendar, F.col(day), "_same")
    e = with_session_after(e, calendar, F.col(day), "_next", strict=True)
    arr = (F.when(F.col(timing) == "bmo", F.array("_same")).when(F.col(timing) == "amc", F.array("_next"))
           .otherwise(F.array("_same", "_next")))
    return (e.withColumn("reaction", F.explode(F.array_distinct(F.filter(arr, lambda x: x.isNotNull()))))
            .drop("_same", "_next"))


def trailing_density(bars: DataFrame, events: DataFrame, key: str, bar_day: str, event_day: str, days: int,
                     sums: dict[str, Column]) -> DataFrame:
    """Sums over the events of the trailing ``days`` per bar, without pairing bars and events.

    Events are first reduced to one row per (key, day); a RANGE frame over the union does the rest.
    """
    daily = events.groupBy(key, F.col(event_day).alias("_d")).agg(*[F.sum(x).alias(o) for o, x in sums.items()])
    left = bars.withColumns({"_d": F.col(bar_day), "_bar": F.lit(True)})
    u = left.unionByName(daily.withColumn("_bar", F.lit(False)), allowMissingColumns=True)
    u = u.withColumn("_n", F.datediff("_d", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(key).orderBy("_n").rangeBetween(-days, 0)
    return (u.withColumns({o: F.coalesce(F.sum(o).over(w), F.lit(0)) for o in sums})
            .where("_bar").drop("_d", "_bar", "_n"))


def distance_to_events(rows: DataFrame, events: DataFrame, key: str, day: str, event_day: str) -> DataFrame:
    """Days since the last event at or before each row and until the next one at or after it."""
    ev = events.select(key, F.col(event_day).alias("_ev")).distinct()
    r = asof_join(rows, ev, key, day, "_ev", {"_ev": "prev_event"})
    r = asof_join(r, ev, key, day, "_ev", {"_ev": "next_event"}, direction="forward")
    return r.withColumns({"days_since": F.datediff(day, "prev_event"), "days_until": F.datediff("next_event", day)})


def nearest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, tolerance_days: int,
            out: str, default: float = 0.0) -> DataFrame:
    """Nearest right value within a tolerance; the earlier one wins a tie; default when none is near."""
    b = asof_join(left, right, key, left_ts, right_ts, {value: "_bv", right_ts: "_bt"})
    b = asof_join(b, right, key, left_ts, right_ts, {value: "_fv", right_ts: "_ft"}, direction="forward")
    db, df_ = F.datediff(left_ts, "_bt"), F.datediff("_ft", left_ts)
    near_b = db.isNotNull() & (df_.isNull() | (db <= df_))
    v = (F.when(near_b & (db <= tolerance_days), F.col("_bv")).when(~near_b & (df_ <= tolerance_days), F.col("_fv")))
    return b.withColumn(out, F.coalesce(v, F.lit(default))).drop("_bv", "_bt", "_fv", "_ft")


def asof_limited(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str, limit: int, lag: int = 0) -> DataFrame:
    """Forward-fill a series onto target rows, at most ``limit`` target rows past its own date.

    A value ages by target rows since its date; ``lag`` shifts by whole target rows.
    """
    w = by_time(key, ts)
    l = left.withColumn("_i", F.row_number().over(w))
    r = right.select(key, F.col(ts).alias("_rt"), F.col(value).alias("_v"))
    j = asof_join(l, r, key, ts, "_rt", {"_v": "_v", "_rt": "_rt"})
    j = j.withColumn("_at", F.min("_i").over(Window.partitionBy(key, "_rt")))
    # a source date that is no target row starts to age one row earlier
    age = F.col("_i") - F.col("_at") + F.when(F.min(ts).over(Window.partitionBy(key, "_rt")) == F.col("_rt"), 0).otherwise(1)
    j = j.withColumn(out, F.when(age <= limit, F.col("_v")))
    if lag:
        j = j.withColumn(out, F.lag(out, lag).over(w))
    return j.drop("_i", "_v", "_rt", "_at")


def anchor_prices(series: DataFrame, anchors: DataFrame, zero_after_end: Column | None = None, key: str = "symbol",
                  ts: str = "session", price: str = "close") -> DataFrame:
    """Price of every key at every anchor date: last at or before it, null before the first row,
    carried after the last row or set to 0 where ``zero_after_end`` holds.

    The anchor list is a short calendar list, so keys are widened by an explode of one array, not by
    a join of two tables.
    """
    lst = anchors.agg(F.sort_array(F.collect_set("anchor")).alias("_as"))
    ends = series.groupBy(key).agg(F.max(ts).alias("_end"), F.min(ts).alias("_beg"))
    grid = ends.join(F.broadcast(lst)).withColumn("anchor", F.explode("_as")).drop("_as")
    j = asof_join(grid, series, key, "anchor", ts, {price: "price"})
    if zero_after_end is not None:
        j = j.withColumn("price", F.when((F.col("anchor") > F.col("_end")) & zero_after_end, F.lit(0.0)).otherwise(F.col("price")))
    return j.drop("_end", "_beg")


def pick_by_layer(candidates: DataFrame, key: Sequence[str], layer: str, tie: Sequence[str]) -> DataFrame:
    """Layered resolution: keep the candidate of the lowest layer per key (map-side combined)."""
    rest = [x for x in candidates.columns if x not in key]
    g = candidates.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(layer, *tie)).alias("_b"))
    return g.select(*key, *[F.col("_b")[x].alias(x) for x in rest])


def best_source_rows(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """All rows of the best available source per key."""
    best = rows.groupBy(key).agg(F.min(priority).alias("_best"))
    return rows.join(best, key).where(F.col(priority) == F.col("_best")).drop("_best")


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key; the window group limit drops the rest before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


#: Series in a tile of the symbol list. Pairs of one session are dealt to pairs of tiles.
TILE = 256


def session_pairs(rows: DataFrame, value: str, n_series: int) -> DataFrame:
    """(a, b, session, xa, xb) for a <= b: the pairs of series within each session.

    The output is as large as the question asks; a session with many series is not one task's work, since
    its pairs are formed in (session, tile, tile) pieces.
    """
    tiles = -(-n_series // TILE) or 1
    t = rows.select("session", F.col("symbol"), F.col(value).alias("x"), F.pmod(F.xxhash64("symbol"), F.lit(tiles)).cast("int").alias("t"))
    t = t.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    t = t.withColumns({"lo": F.least("t", "o"), "hi": F.greatest("t", "o")}).drop("o")
    a, b = (t.select("session", "lo", "hi", F.col("symbol").alias(k), F.col("x").alias(f"x{k}"), F.col("t").alias(f"t{k}")) for k in ("a", "b"))
    own = (F.least("ta", "tb") == F.col("lo")) & (F.greatest("ta", "tb") == F.col("hi"))
    return a.join(b, ["session", "lo", "hi"]).where((F.col("a") <= F.col("b")) & own).select("a", "b", "session", "xa", "xb")


#: Most series in a tile of the correlation, and the sessions it takes at a time: six products of their values and flags are held.
CORR_TILE, CORR_SESSIONS = 1024, 2048
#: Parts the tiles are dealt to; a task meets one part with another, with a single tile each up to this many tiles.
CORR_PARTS = 128
#: Variance this small against the sum of squares is taken again from the two series alone.
CORR_DOUBT = 1e-7


def _pair_exact(x: np.ndarray, y: np.ndarray) -> float:
    """Correlation of two lists in two passes, measured from their first values."""
    x, y = x - x[0], y - y[0]
    x, y = x - x.mean(), y - y.mean()
    v = math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())
    return float((x * y).sum() / v) if v > 0 else math.nan


def _tile_corr(min_obs: int):
    def run(group: pa.Table) -> pa.Table:
        """Correlations of the pairs between two tiles of series (or within one) from products of their matrices."""
        group = group.combine_chunks()
        group = group.take(pc.sort_indices(group, [("symbol", "ascending")]))
        kind = group.schema.field("symbol").type
        side = group.column("t").to_numpy()
        same = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        items = group.column("r").combine_chunks()
        flat, at = items.flatten(), np.repeat(np.arange(len(group)), pc.list_value_length(items).to_numpy(zero_copy_only=False))
        days = flat.field("session").dictionary_encode()
        day, n_days = days.indices.to_numpy(), len(days.dictionary)
        x = flat.field("x").to_numpy(zero_copy_only=False).astype(float)
        null = flat.field("x").is_null().to_numpy(zero_copy_only=False)
        odd = ~null & ~np.isfinite(x)
        x = np.where(null | odd, 0.0, x)
        # values are measured from each series' median, so sums of squares keep their digits
        o = np.lexsort((x, null | odd, at))
        cut = np.searchsorted(at, np.arange(len(group) + 1))
        good = np.bincount(at, ~(null | odd), len(group)).astype(int)
        mid = np.where(good > 0, x[o[np.minimum(cut[:-1] + good // 2, len(x) - 1)]], 0.0)
        x = np.where(null | odd, 0.0, x - mid[at])
        a = np.flatnonzero(side == side.min()) if not same else np.arange(len(group))
        b = np.flatnonzero(side == side.max()) if not same else a
        by_day = np.argsort(day, kind="stable")
        width = -(-n_days // -(-n_days // CORR_SESSIONS))
        starts = np.searchsorted(day[by_day], np.arange(0, n_days + width, width))
        shape = (len(a), len(b))
        n, k, sx, sy, sxx, syy, sxy, bad = (np.zeros(shape) for _ in range(8))
        for c in range(len(starts) - 1):
            e = by_day[starts[c]:starts[c + 1]]
            cell, size = at[e] * width + day[e] - c * width, len(group) * width
            grid = lambda w: np.bincount(cell, w, size).reshape(len(group), width)
            m, v, q = grid((~null[e]).astype(float)), grid(x[e]), grid(x[e] * x[e])
            k += m[a] @ m[b].T
            sx += v[a] @ m[b].T
            sy += m[a] @ v[b].T
            sxx += q[a] @ m[b].T
            syy += m[a] @ q[b].T
            sxy += v[a] @ v[b].T
            if null.any():
                rows = grid(np.ones(len(e)))
                n += rows[a] @ rows[b].T
            if odd.any():
                z = grid(odd[e].astype(float))
                bad += z[a] @ m[b].T + m[a] @ z[b].T
        n = n if null.any() else k
        take = n >= max(min_obs, 1)
        if same:
            take &= a[:, None] < b[None, :]
        i, j = np.nonzero(take)
        n, k, sx, sy, sxx, syy, sxy, bad = (z[i, j] for z in (n, k, sx, sy, sxx, syy, sxy, bad))
        with np.errstate(all="ignore"):
            vx, vy = sxx - sx * sx / k, syy - sy * sy / k
            corr = np.where((vx > 0) & (vy > 0), (sxy - sx * sy / k) / np.sqrt(vx) / np.sqrt(vy), np.nan)
        corr[bad > 0] = np.nan
        doubt = (bad == 0) & (k > 0) & (((sxx > 0) & (vx < CORR_DOUBT * sxx)) | ((syy > 0) & (vy < CORR_DOUBT * syy)))
        for p in np.flatnonzero(doubt):
            ea, eb = (np.arange(cut[z], cut[z + 1]) for z in (a[i[p]], b[j[p]]))
            # every row of one series meets every row of the other of its session
            u, v = np.nonzero((day[ea][:, None] == day[eb][None, :]) & ~null[ea][:, None] & ~null[eb][None, :])
            corr[p] = _pair_exact(x[ea[u]], x[eb[v]])
        names = group.column("symbol").combine_chunks()
        first, second = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])  # rows are in the order of the symbols
        return pa.table({"a": names.take(pa.array(first)), "b": names.take(pa.array(second)), "corr": pa.array(corr, mask=k == 0), "n": n.astype("int64")},
                        schema=pa.schema([("a", kind), ("b", kind), ("corr", pa.float64()), ("n", pa.int64())]))
    return run


def _tiles(size: int):
    """Series, as they come, to rows (id, tile) of at most ``size`` series each, as one Arrow stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held, n = [*held, batch], n + batch.num_rows
            while n >= size or (batch is None and n):
                t = pa.Table.from_batches(held).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema) as out:
                    out.write_table(t.slice(0, size))
                held, n = t.slice(size).to_batches(), max(0, n - size)
                yield pa.record_batch({"id": pa.array([first + made], pa.int64()), "tile": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                made += 1
    return run


def _pairs_of_tiles(min_obs: int):
    corr = _tile_corr(min_obs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, *tiles in zip(*(batch.column(x) for x in ("lo", "hi", "tile_lo", "tile_hi"))):
                same = lo == hi
                sides = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in tiles[:1 if same else 2]]
                sides = [t.append_column("t", pa.array(np.full(len(t), k, "int32"))) for k, t in enumerate(sides)]
                g = pa.concat_tables(sides)
                g = g.append_column("lo", pa.array(np.zeros(len(g), "int32"))).append_column("hi", pa.array(np.full(len(g), 0 if same else 1, "int32")))
                yield from corr(g).to_batches()
    return run


def pairwise_corr(returns: DataFrame, min_obs: int = 20, min_corr: float | None = None) -> DataFrame:
    """Correlation of all pairs of series over their common sessions; NaN where one of them does not vary.

    A series is packed into one row (the calendar bounds it) and series into tiles, each one row that is written once. A pair of
    tiles is one piece of work of bounded size: counts, sums and products of all its pairs of series come from products of (series,
    session) matrices, so no pair of rows is ever formed. Its task reads the two tiles where they are, so what is written and shuffled
    is each series once, whatever the number of tiles.
    """
    kind = returns.schema["symbol"].dataType.simpleString()
    packed = (returns.where(F.col("symbol").isNotNull() & F.col("session").isNotNull())
              .groupBy("symbol").agg(F.array_agg(F.struct("session", F.col("ret").cast("double").alias("x"))).alias("r")))
    packed = materialize(packed, "series")
    n_series = packed.count()
    size = max(64, min(CORR_TILE, n_series // 16))
    tiles = materialize(packed.coalesce(-(-n_series // size) or 1).mapInArrow(_tiles(size), "id bigint, tile binary"), "tiles")
    ids = sorted(r["id"] for r in tiles.select("id").collect()) or [-1]  # one for each tile
    at = F.array_position(F.array(*[F.lit(x).cast("bigint") for x in ids]), F.col("id")).cast("int")
    n = min(len(ids), CORR_PARTS)
    dealt = tiles.withColumn("k", at).repartitionById(n, F.col("k") % n)
    lo, hi = (dealt.select(F.col("k").alias(x), F.col("tile").alias(f"tile_{x}")) for x in ("lo", "hi"))
    g = lo.join(hi.hint("shuffle_replicate_nl"), F.col("lo") <= F.col("hi")).mapInArrow(_pairs_of_tiles(min_obs), f"a {kind}, b {kind}, corr double, n bigint")
    return g.where(F.col("corr") >= min_corr) if min_corr is not None else g
