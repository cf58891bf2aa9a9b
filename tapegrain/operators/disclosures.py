"""Disclosed trades: parsing, queries, insider and political signals, copy scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import asof_join, by_time, exact_quantiles


def scorecards(buys: DataFrame, bars: DataFrame, market: DataFrame, horizon: int, min_buys: int) -> DataFrame:
    """Log excess of buying at the first open after each filing and holding ``horizon`` bars, per owner."""
    w = by_time("symbol", "session")
    b = bars.select(F.col("symbol").alias("issuer"), "session", F.col("session").alias("_es"), F.col("open").alias("_eo"),
                    F.lead("session", horizon).over(w).alias("_xs"), F.lead("open", horizon).over(w).alias("_xo"))
    e = asof_join(buys, b, "issuer", "filed", "session", {"_es": "_es", "_eo": "_eo", "_xs": "_xs", "_xo": "_xo"}, direction="forward", allow_equal=False)
    m1 = F.broadcast(market.select(F.col("session").alias("_es"), F.col("open").alias("_m1")))
    m2 = F.broadcast(market.select(F.col("session").alias("_xs"), F.col("open").alias("_m2")))
    e = e.join(m1, "_es", "left").join(m2, "_xs", "left")
    e = e.withColumn("excess", F.log(F.col("_xo") / F.col("_eo")) - F.log(F.col("_m2") / F.col("_m1")))
    n, s = F.count("excess"), F.stddev_samp("excess")
    g = e.groupBy("owner").agg(F.count(F.lit(1)).alias("buys"), n.alias("n"), F.avg("excess").alias("mean_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("hit_rate"),
                               F.when((n > 2) & (s > 0), F.avg("excess") / (s / F.sqrt(n))).alias("t_stat"), F.avg(F.datediff("filed", "trade_date")).alias("mean_lag"))
    q = exact_quantiles(e, ["owner"], "excess", {"median_excess": 0.5})
    return g.where(F.col("buys") >= min_buys).join(q, "owner", "left")


# Layout of disclosure reports.
TRADE_LINE = r"(?i)(?:^|\s)(P|S \(partial\)|S|E)\s+(\d{2}/\d{2}/\d{4})\s+(\d{2}/\d{2}/\d{4})\s+\$([\d,]+)(?:\s*-\s*\$?([\d,]+))?"
LABEL_LINE = r"^(F\s+S|S\s+O|L|D|C)\s*:\s*(.*)$"
HEADER_LINE = (r"^(Filing ID|ID Owner|Type$|Date Notification|Date$|Amount Cap|Gains >|\$200\?|\* For the complete|P T R|"
               r"Clerk of the House|F I$|Name:|Status:|State/District:|T$|I P O|I CERTIFY|C S$|Digitally Signed|Yes No|my knowledge)")
OWNER_LINE = r"^(SP|JT|DC)\s+"
LOOSE_DATES = r"\n\s*(\d{2}/\d{2}/\d{4}\s+\d{2}/\d{2}/\d{4}\s+\$)"
TICKER_MARK = r"\(([A-Za-z][A-Za-z.\-]{0,5})\)"
ASSET_MARK = r"\[(\w{2})\]"
SIDES = {"P": "buy", "S": "sell", "S (PARTIAL)": "sell_partial", "E": "exchange"}


def parse_disclosures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Trade rows from report texts, by set rules over numbered lines instead of a line-by-line reader.

    A trade line opens a record. Lines after it belong to the record (upper amount, labels, text
    that continues a description) until the first line that can do neither; from there on they name
    the asset of the next record. All windows are per document.
    """
    joined = F.regexp_replace(F.regexp_replace(text, "\u0000", ""), LOOSE_DATES, " $1")
    l = docs.select(id_col, F.posexplode(F.split(joined, "\r?\n")).alias("_i", "_raw"))
    l = l.withColumn("line", F.trim(F.regexp_replace("_raw", r"\s+", " "))).where((F.col("line") != "") & ~F.col("line").rlike(HEADER_LINE))
    w = Window.partitionBy(id_col).orderBy("_i")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    tx = F.col("line").rlike(TRADE_LINE)
    l = l.withColumn("_tx", tx.cast("int")).withColumn("rec", F.sum("_tx").over(run))
    g = lambda k: F.regexp_extract("line", TRADE_LINE, k)
    open_amount = F.max(F.when(F.col("_tx") == 1, (g(5) == "").cast("int"))).over(Window.partitionBy(id_col, "rec"))
    wr = Window.partitionBy(id_col, "rec").orderBy("_i")
    amt = (F.col("_tx") == 0) & (F.col("rec") > 0) & (open_amount == 1) & F.col("line").rlike(r"^\$[\d,]+$")
    l = l.withColumn("_amt", amt.cast("int"))
    l = l.withColumn("_amt", F.when((F.col("_amt") == 1) & (F.sum("_amt").over(wr.rowsBetween(Window.unboundedPreceding, 0)) == 1), 1).otherwise(0))
    label = F.when((F.col("_tx") == 0) & (F.col("rec") > 0) & F.col("line").rlike(LABEL_LINE), F.regexp_replace(F.regexp_extract("line", LABEL_LINE, 1), r"\s+", " "))
    l = l.withColumn("_label", label)
    before = wr.rowsBetween(Window.unboundedPreceding, -1)
    l = l.withColumns({"_cur": F.last("_label", ignorenulls=True).over(before), "_prev": F.lag("line").over(wr)})
    goes_on = (F.col("_cur") == "D") & ~F.col("line").rlike(OWNER_LINE) & ~F.contains(F.col("line"), F.lit("[")) & ~F.col("_prev").endswith(".")
    plain = (F.col("_tx") == 0) & (F.col("_amt") == 0) & F.col("_label").isNull()
    stop = plain & ~F.coalesce(goes_on, F.lit(False))
    l = l.withColumn("_stop", (stop | (F.col("rec") == 0)).cast("int"))
    l = l.withColumn("_asset", (F.max("_stop").over(wr.rowsBetween(Window.unboundedPreceding, 0)) == 1) & (F.col("_tx") == 0))
    own = ~F.col("_asset") & (F.col("_tx") == 0)
    value = F.regexp_extract("line", LABEL_LINE, 2)
    text_of = lambda cond, x: F.array_join(F.transform(F.array_sort(F.array_agg(F.when(cond, F.struct("_i", x.alias("v"))))), lambda z: z["v"]), " ")
    rec = l.groupBy(id_col, "rec").agg(
        F.max(F.when(F.col("_tx") == 1, F.col("line"))).alias("line"),
        text_of(F.col("_asset"), F.col("line")).alias("_next_asset"),
        F.max(F.when(own & (F.col("_amt") == 1), F.col("line"))).alias("_more"),
        text_of(own & ((F.col("_label") == "D") | (plain & (F.col("_cur") == "D"))), F.when(F.col("_label") == "D", value).otherwise(F.col("line"))).alias("description"),
        F.max(F.when(own & (F.col("_label") == "S O"), value)).alias("subholding"))
    rec = rec.withColumn("_asset", F.lag("_next_asset").over(Window.partitionBy(id_col).orderBy("rec"))).where(F.col("line").isNotNull())
    head = F.regexp_extract("line", "(?i)^(.*?)" + TRADE_LINE[4:], 1)
    rec = rec.withColumn("_a", F.trim(F.concat_ws(" ", F.nullif("_asset", F.lit("")), F.nullif(F.trim(head), F.lit("")))))
    owned = r"(?i)^(?:.*\s)?(sp|jt|dc)\s+(?=\S)"
    rec = rec.withColumns({"owner": F.upper(F.regexp_extract("_a", owned, 1)), "_a": F.regexp_replace("_a", owned, "")})
    num = lambda s: F.nullif(F.regexp_replace(s, "[^0-9]", ""), F.lit("")).cast("bigint")
    sides = F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv])
    kind = F.upper(F.regexp_extract("_a", ASSET_MARK, 1))
    kind = F.when(kind != "", kind).when(F.contains(F.lower("description"), F.lit("option")), "OP").otherwise("ST")
    return rec.select(
        id_col, "rec", "owner", F.nullif(F.upper(F.regexp_extract("_a", TICKER_MARK, 1)), F.lit("")).alias("ticker"),
        F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("_a", TICKER_MARK, ""), ASSET_MARK, ""), r"\s+", " ")).alias("asset_name"),
        kind.alias("asset_type"), F.element_at(sides, F.upper(g(1))).alias("side"),
        F.to_date(g(2), "MM/dd/yyyy").alias("traded_at"), F.to_date(g(3), "MM/dd/yyyy").alias("notified_at"),
        num(g(4)).alias("amount_min"), F.coalesce(num(g(5)), num(F.col("_more"))).alias("amount_max"), "description",
        F.coalesce("subholding", F.lit("")).alias("subholding"))


def insider_signal(tx: DataFrame, as_of: Column, key: str = "issuer") -> DataFrame:
    """90-day buys and sells, net value, distinct 30-day buyers and sellers, cluster bonus."""
    age = F.datediff(as_of, "filed")
    d = tx.where((age >= 0) & (age <= 90))
    buy = F.col("code") == "P"
    signed = F.when(buy, F.col("value")).otherwise(-F.col("value"))
    # owners are reduced per (key, owner) first, so distinct counts need no sets
    o = d.groupBy(key, "owner").agg(F.sum(buy.cast("int")).alias("_b"), F.sum((~buy).cast("int")).alias("_s"), F.sum(signed).alias("_v"),
                                    F.max((buy & (age <= 30)).cast("int")).alias("_rb"), F.max((~buy & (age <= 30)).cast("int")).alias("_rs"))
    g = o.groupBy(key).agg(F.sum("_b").alias("n_buys"), F.sum("_s").alias("n_sells"), F.sum("_v").alias("net_value"),
                           F.sum("_rb").alias("buyers_30d"), F.sum("_rs").alias("sellers_30d"))
    n = F.col("n_buys") + F.col("n_sells")
    raw = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.6 * (F.col("n_buys") - F.col("n_sells")) / n + 0.4 * F.tanh(F.col("net_value") / 5e6)))
    g = g.withColumn("_raw", raw)
    bonus = (F.when((F.col("buyers_30d") >= 3) & (F.col("_raw") > 0), F.least(F.lit(0.30), 0.10 * (F.col("buyers_30d") - 2)))
             .when((F.col("sellers_30d") >= 4) & (F.col("_raw") < 0), -F.least(F.lit(0.20), 0.05 * (F.col("sellers_30d") - 3))).otherwise(0.0))
    g = g.withColumn("bonus", bonus)
    return g.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_raw") + F.col("bonus")))).drop("_raw")


def political_signal(tx: DataFrame, as_of: Column, weights: dict, key: str = "issuer", who: str = "owner") -> DataFrame:
    """180-day dollars, some names counted double, squashed; the three largest contributors."""
    age = F.datediff(as_of, "trade_date")
    d = tx.where((age >= 0) & (age <= 180))
    w = F.lit(1.0)
    for name, x in weights.items():
        w = F.when(F.col(who) == name, x).otherwise(w)
    buy = F.col("code") == "P"
    p = d.groupBy(key, who).agg(F.sum(F.when(buy, 1.0).otherwise(-1.0) * w * F.col("value")).alias("_net"), F.sum(buy.cast("int")).alias("_b"), F.count(F.lit(1)).alias("_n"))
    g = p.groupBy(key).agg(F.sum("_net").alias("net"), F.sum("_b").alias("n_buys"), (F.sum("_n") - F.sum("_b")).alias("n_sells"))
    wr = Window.partitionBy(key).orderBy(F.desc(F.abs("_net")), who)
    top = (p.withColumn("_rn", F.row_number().over(wr)).where(F.col("_rn") <= 3).groupBy(key)
           .agg(F.transform(F.array_sort(F.array_agg(F.struct("_rn", who))), lambda z: z[who]).alias("top")))
    return g.join(top, key).withColumn("score", F.tanh(F.col("net") / 1e6))


def detect_clusters(tx: DataFrame, window_days: int = 30, min_insiders: int = 2, min_value: float = 100_000.0, cooldown_days: int = 182) -> DataFrame:
    """Cluster-buy events keyed to the filing date that completes the cluster, one per cooldown.

    Purchases are reduced to (issuer, owner, day). Distinct owners in the trailing window are counted
    without sets: an owner-day opens a stretch that lasts until the owner's next filing or the end of
    the window, so the count is a running sum of openings and closings. The greedy cooldown is a fold
    over the qualifying days of one issuer, which the calendar bounds.
    """
    d = tx.groupBy("issuer", "owner", F.col("filed").alias("day")).agg(F.sum("value").alias("v"))
    nxt = F.lead("day").over(Window.partitionBy("issuer", "owner").orderBy("day"))
    d = d.withColumn("_until", F.least(F.coalesce(nxt, F.date_add("day", window_days)), F.date_add("day", window_days)))
    steps = d.select("issuer", F.explode(F.array(
        F.struct(F.col("day").alias("day"), F.lit(1).alias("dn"), F.col("v").alias("dv")),
        F.struct(F.col("_until").alias("day"), F.lit(-1).alias("dn"), F.lit(0.0).alias("dv")),
        F.struct(F.date_add("day", window_days).alias("day"), F.lit(0).alias("dn"), (-F.col("v")).alias("dv")))).alias("z")).select("issuer", "z.*")
    s = steps.groupBy("issuer", "day").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"))
    w = Window.partitionBy("issuer").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"n_insiders": F.sum("dn").over(w), "total_value": F.sum("dv").over(w)})
    days = d.select("issuer", "day").distinct()
    q = s.join(days, ["issuer", "day"]).where((F.col("n_insiders") >= min_insiders) & (F.col("total_value") >= min_value - 1e-6))
    a = q.groupBy("issuer").agg(F.array_sort(F.array_agg(F.struct("day", "n_insiders", "total_value"))).alias("ds"))
    item = "array<struct<day:date,n_insiders:bigint,total_value:double>>"
    keep = F.aggregate("ds", F.array().cast(item), lambda acc, x: F.when(
        (F.size(acc) == 0) | (F.datediff(x["day"], F.try_element_at(acc, F.lit(-1))["day"]) >= cooldown_days), F.concat(acc, F.array(x).cast(item))).otherwise(acc))
    return a.select("issuer", F.inline(keep)).withColumnRenamed("day", "signal_date")
