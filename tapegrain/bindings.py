"""How the supplied tables stand in for market tables, as DataFrames and as the same SQL text.

symbol = supplier, session = ship date, price = extended price per unit, volume = quantity.
Bars are pre-aggregated with partial aggregation, so a symbol that owns a third of all lines
still ends as at most one row per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrain.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_bound(spark: SparkSession, sf_dir: str) -> int:
    """Proven limit of rows per session in a symbol panel: the number of suppliers."""
    return table(spark, sf_dir, "supplier").count()


_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _ohlc(lines: DataFrame, *keys) -> DataFrame:
    tie = F.struct(*_TIE)
    return lines.groupBy(*keys).agg(
        F.min_by("p", tie).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", tie).alias("close"), F.sum("l_quantity").alias("volume"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem")
            .select(*_TIE, "l_suppkey", "l_quantity", "l_returnflag", "l_discount", "l_tax",
                    F.to_date("l_shipdate").alias("session"),
                    (F.col("l_extendedprice") / F.col("l_quantity")).alias("p")))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ohlc(lines(spark, sf_dir), F.col("l_suppkey").alias("symbol"), "session")


#: Rows of lineitem for each task that windows over whole symbols or documents.
TASK_LINES = 100_000


def spread(df: DataFrame, spark: SparkSession, sf_dir: str, *keys: str, rows: int = TASK_LINES) -> DataFrame:
    """Rows dealt by ``keys`` to as many tasks as the lines ask for, so that the memory of one does not grow with the input.

    Adaptive coalescing fills tasks by compressed bytes of what is shuffled, whatever the windows after it hold. The count is read from
    the file's footers; it is an upper bound of the bars and of what is grouped from the lines.
    """
    n = -(-table(spark, sf_dir, "lineitem").count() // rows)
    return df.repartition(max(n, spark.sparkContext.defaultParallelism), *keys)


#: A symbol with more lines than this is grouped by partial sums first, as its raw lines would fill one task.
HOT_LINES = 10 * TASK_LINES


def symbol_bars(spark: SparkSession, sf_dir: str, rows: int = TASK_LINES) -> DataFrame:
    """``daily_bars`` for long chains of windows over a symbol, with one shuffle: raw lines are dealt by symbol, and bars and windows
    follow in the same task. Partial sums of bars hold each line's tie and prices twice and are no fewer than the lines unless
    a symbol has many lines a session; where one has more than ``HOT_LINES``, bars are grouped first and dealt after it."""
    li = table(spark, sf_dir, "lineitem")
    most = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > HOT_LINES:
        return spread(daily_bars(spark, sf_dir), spark, sf_dir, "symbol", rows=rows)
    raw = li.select(*_TIE, "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("session"))
    raw = spread(raw, spark, sf_dir, "l_suppkey", rows=rows).withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    return _ohlc(raw, F.col("l_suppkey").alias("symbol"), "session")


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One benchmark series over all lines; rows bounded by the calendar."""
    b = lines(spark, sf_dir).groupBy("session").agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.max("p").alias("high"), F.min("p").alias("low"), F.sum("l_quantity").alias("volume"),
        F.avg("p").alias("open"))
    return b.select(F.lit("MKT").alias("symbol"), "session", "open", "high", "low", "close", "volume")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol -> nation, region. Nation and region are fixed lists (25 and 5 rows)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), "s_nationkey")
    n = F.broadcast(table(spark, sf_dir, "nation"))
    r = F.broadcast(table(spark, sf_dir, "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select("symbol", F.col("n_name").alias("industry"), F.col("r_name").alias("sector")))


def sector_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-weight level per region and session: the sector proxy series."""
    b = daily_bars(spark, sf_dir).select("symbol", "session", "vwap", "volume")
    return (b.join(sectors(spark, sf_dir).select("symbol", "sector"), "symbol")
            .groupBy("sector", "session")
            .agg((F.sum(F.col("vwap") * F.col("volume")) / F.sum("volume")).alias("close")))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered sessions. One row per day: bounded by time, not by the data."""
    from pyspark.sql import Window
    d = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct()
    return d.withColumn("ord", F.row_number().over(Window.partitionBy().orderBy("session")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("symbol"), F.col("user_id").alias("account"),
                    F.col("value").alias("price"),
                    F.get_json_object("props", "$.k").cast("double").alias("size"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio transactions: buys and sells per customer and symbol."""
    li, o = lines(spark, sf_dir), table(spark, sf_dir, "orders")
    return (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("portfolio"), F.col("l_suppkey").alias("symbol"),
                    "session", "l_orderkey", "l_linenumber", "l_partkey",
                    F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
                    F.col("l_quantity").alias("qty"), F.col("p").alias("price"),
                    (F.col("l_extendedprice") * F.col("l_tax") * 0.01).alias("fee")))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider-style trades with a trade date and a later filed date."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("l_suppkey").alias("issuer"), F.col("o_custkey").alias("owner"),
                    F.to_date("o_orderdate").alias("trade_date"),
                    F.date_add(F.to_date("o_orderdate"), F.col("l_linenumber") * 7).alias("filed"),
                    F.when(F.col("l_returnflag") == "R", "S").otherwise("P").alias("code"),
                    F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("shares"),
                    F.col("o_orderpriority").alias("role"), "l_orderkey", "l_linenumber", "l_partkey"))


# --- the same expressions as DuckDB text --------------------------------------------------------

_T = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice"
LINES = """lines AS (SELECT *, CAST(l_shipdate AS DATE) AS session, l_extendedprice / l_quantity AS p FROM lineitem)"""
BARS = f"""{LINES}, bars AS (
  SELECT l_suppkey AS symbol, session, first(p {_T}) AS open, max(p) AS high, min(p) AS low,
         last(p {_T}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap
  FROM lines GROUP BY 1, 2)"""
MARKET = """mkt AS (SELECT 'MKT' AS symbol, CAST(l_shipdate AS DATE) AS session,
  sum(l_extendedprice) / sum(l_quantity) AS close, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume,
  avg(l_extendedprice / l_quantity) AS open FROM lineitem GROUP BY 2)"""
SECTORS = """sectors AS (SELECT s_suppkey AS symbol, n_name AS industry, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SECTOR_BARS = """sector_bars AS (SELECT sector, session, sum(vwap * volume) / sum(volume) AS close
  FROM bars JOIN sectors USING (symbol) GROUP BY 1, 2)"""
CALENDAR = """cal AS (SELECT session, row_number() OVER (ORDER BY session) AS ord
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem))"""
TICKS = """ticks AS (SELECT event_id, ts, event_type AS symbol, user_id AS account, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events)"""
TRANSACTIONS = """tx AS (SELECT o_custkey AS portfolio, l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS session,
  l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
  l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice * l_tax * 0.01::DOUBLE AS fee
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
FILINGS = """fil AS (SELECT l_suppkey AS issuer, o_custkey AS owner, CAST(o_orderdate AS DATE) AS trade_date,
  CAST(o_orderdate AS DATE) + l_linenumber * 7 AS filed, CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'P' END AS code,
  l_extendedprice AS value, l_quantity AS shares, o_orderpriority AS role, l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# --- derived inputs -----------------------------------------------------------------------------

def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly revenue, cost and units per symbol, known 30 to 75 days after the quarter ends."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    g = (li.join(o, li.l_orderkey == o.o_orderkey)
         .groupBy(F.col("l_suppkey").alias("symbol"), F.year("o_orderdate").alias("_y"), F.quarter("o_orderdate").alias("_q"))
         .agg(F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("income"),
              F.sum("l_quantity").alias("units")))
    end = F.last_day(F.make_date("_y", F.col("_q") * 3, F.lit(1)))
    lag = (30 + (F.col("symbol") * 7 + F.col("_y") + F.col("_q")) % 46).cast("int")
    return g.select("symbol", end.alias("period_end"), F.date_add(end, lag).alias("available_at"), "revenue", "income", "units")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded share splits per symbol and ex-date."""
    li = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.1))
    return (li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("ex_date"))
            .agg((1.0 + F.max("l_linenumber")).alias("ratio")))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash per share by ex-date."""
    li = table(spark, sf_dir, "lineitem").where((F.col("l_tax") == 0) & (F.col("l_discount") == 0))
    return (li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("ex_date"))
            .agg((F.sum("l_extendedprice") * 0.0001).alias("amount")))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earnings-style reports: one per symbol and order date of urgent orders, with a timing code and a surprise."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    g = (li.join(o, li.l_orderkey == o.o_orderkey)
         .groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("o_orderdate").alias("date"))
         .agg(F.min("l_linenumber").alias("_m"), (F.avg(F.col("l_discount") - F.col("l_tax")) * 100).alias("surprise")))
    t = F.when(F.col("_m") % 3 == 0, "bmo").when(F.col("_m") % 3 == 1, "amc").otherwise("unknown")
    return g.select("symbol", "date", t.alias("timing"), "surprise")


FUNDAMENTALS = """fun AS (SELECT symbol, pe AS period_end, pe + CAST(30 + (symbol * 7 + y + q) % 46 AS INTEGER) AS available_at, revenue, income, units FROM
 (SELECT l_suppkey AS symbol, year(o_orderdate) AS y, quarter(o_orderdate) AS q, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS pe,
  sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) AS income, sum(l_quantity) AS units
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4))"""
SPLITS = """splits AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex_date, 1.0::DOUBLE + max(l_linenumber) AS ratio FROM lineitem
 WHERE l_quantity >= 49 AND l_returnflag = 'R' AND l_discount = 0.1::DOUBLE GROUP BY 1, 2)"""
DIVIDENDS = """dvd AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex_date, sum(l_extendedprice) * 0.0001::DOUBLE AS amount FROM lineitem
 WHERE l_tax = 0 AND l_discount = 0 GROUP BY 1, 2)"""
REPORTS = """rep AS (SELECT symbol, date, CASE WHEN m % 3 = 0 THEN 'bmo' WHEN m % 3 = 1 THEN 'amc' ELSE 'unknown' END AS timing, surprise FROM
 (SELECT l_suppkey AS symbol, CAST(o_orderdate AS DATE) AS date, min(l_linenumber) AS m, avg(l_discount - l_tax) * 100 AS surprise
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2))"""
