"""Readers and sinks, run over files and documents that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.operators import joins as J
from tapegrain.plans.catalog import day, ds, query, rnd, rs
from tapegrain.plans.windows import WS
from tapegrain.session import fresh_path
from tapegrain.sources import readers as R

OHLC = ("open", "high", "low", "close")


@query("src01_feed_precedence", f"""WITH {B.BARS}, a AS (SELECT * FROM bars WHERE volume >= 20), b AS (SELECT symbol, session, close * 1.01::DOUBLE AS close FROM bars WHERE volume >= 5), c AS (SELECT symbol, session, close * 0.99::DOUBLE AS close FROM bars)
 SELECT c.symbol, {ds('c.session')} AS session, {rs('coalesce(a.close, b.close, c.close)')} AS close, CASE WHEN a.close IS NOT NULL THEN 0 WHEN b.close IS NOT NULL THEN 1 ELSE 2 END AS source_rank
 FROM c LEFT JOIN b USING (symbol, session) LEFT JOIN a USING (symbol, session)""")
def feed_precedence(spark, d):
    b = B.daily_bars(spark, d).select("symbol", "session", "close", "volume")
    feeds = [b.where(F.col("volume") >= 20), b.where(F.col("volume") >= 5).withColumn("close", F.col("close") * 1.01), b.withColumn("close", F.col("close") * 0.99)]
    return R.by_precedence([f.drop("volume") for f in feeds], ["symbol", "session"]).select("symbol", day().alias("session"), rnd("close").alias("close"), "source_rank")


@query("set03_add_missing", f"""WITH {B.BARS} SELECT symbol, {ds()} AS session, {rs('CASE WHEN volume >= 20 THEN close ELSE open END')} AS close FROM bars""")
def add_missing(spark, d):
    b = B.daily_bars(spark, d)
    base = b.where(F.col("volume") >= 20).select("symbol", "session", "close")
    return R.add_missing(base, b.select("symbol", "session", F.col("open").alias("close")), ["symbol", "session"]).select("symbol", day().alias("session"), rnd("close").alias("close"))


@query("src03_paged_json", f"WITH {B.BARS} SELECT symbol, {ds()} AS session, {rs('open')} AS open, {rs('close')} AS close, volume FROM bars")
def paged_json(spark, d):
    """Pages are written as JSON lines (one page per symbol and year) and read with a schema."""
    b = B.daily_bars(spark, d)
    bar = F.struct(F.col("session").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    path = fresh_path(spark, "pages")
    b.groupBy(F.col("symbol").cast("string").alias("symbol"), F.year("session").alias("next_page")).agg(F.array_agg(bar).alias("bars")).write.json(path)
    r = R.paged_bars(spark, path)
    return r.select(F.col("symbol").cast("bigint").alias("symbol"), day().alias("session"), rnd("open").alias("open"), rnd("close").alias("close"), "volume")


@query("src10_chart_json", f"""WITH {B.BARS} SELECT symbol, {ds()} AS session, {rs('open * 0.5::DOUBLE')} AS open, {rs('close * 0.5::DOUBLE')} AS close, volume FROM bars""")
def chart_json(spark, d):
    """Chart payloads per symbol and year, adjusted close at half the close, stamped in two exchanges' time."""
    b = B.daily_bars(spark, d)
    g = b.groupBy("symbol", F.year("session").alias("y")).agg(F.array_sort(F.array_agg(F.struct("session", "open", "high", "low", "close", "volume"))).alias("a"))
    arr = lambda x: F.transform("a", lambda z: z[x]).alias(x)
    east = F.col("symbol") % 2 == 1
    stamp_ = F.transform("a", lambda z: F.unix_timestamp(z["session"].cast("timestamp")) + F.when(east, -9 * 3600).otherwise(20 * 3600)).alias("timestamp")
    meta = F.struct(F.col("symbol").cast("string").alias("symbol"), F.when(east, "Asia/Tokyo").otherwise("America/New_York").alias("exchangeTimezoneName")).alias("meta")
    quote = F.array(F.struct(*[arr(x) for x in OHLC], arr("volume"))).alias("quote")
    adj = F.array(F.struct(F.transform("a", lambda z: z["close"] * 0.5).alias("adjclose"))).alias("adjclose")
    p = g.select(F.to_json(F.struct(F.struct(F.array(F.struct(meta, stamp_, F.struct(quote, adj).alias("indicators"))).alias("result")).alias("chart"))).alias("payload"))
    r = R.chart_bars(p)
    return r.select(F.col("symbol").cast("bigint").alias("symbol"), day().alias("session"), rnd("open").alias("open"), rnd("close").alias("close"), "volume")


@query("prj10_bar_sanity", f"""WITH {B.LINES}, q AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN NULL ELSE p END AS o, p * (1 + l_tax) AS h, p * (1 + l_discount - 0.05::DOUBLE) AS l, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS v FROM lines)
 SELECT l_orderkey, l_linenumber, l_partkey, coalesce(v, 0) AS volume FROM q WHERE o IS NOT NULL AND h >= l""")
def bar_sanity(spark, d):
    li = B.lines(spark, d)
    q = li.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_discount") != 0, F.col("p")).alias("open"), (F.col("p") * (1 + F.col("l_tax"))).alias("high"),
                  (F.col("p") * (1 + F.col("l_discount") - 0.05)).alias("low"), F.col("p").alias("close"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("volume"))
    return R.sane(q).select("l_orderkey", "l_linenumber", "l_partkey", "volume")


@query("prj09_repair_prints", f"""WITH {B.BARS}, a AS (SELECT symbol, session, open, high, low, close, abs(close - lag(close) OVER ({WS})) AS ac, lag(close) OVER ({WS}) AS p, lead(close) OVER ({WS}) AS n FROM bars),
 s AS (SELECT *, CASE WHEN count(ac) OVER w >= 21 THEN quantile_cont(ac, 0.5) OVER w END AS sc FROM a WINDOW w AS ({WS} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, coalesce(abs(close - p) > 3 * sc AND abs(close - n) > 3 * sc AND abs(n - p) < 1.5 * sc, false) AS spike FROM s), g AS (SELECT *, CASE WHEN spike THEN (p + n) / 2 ELSE close END AS c2 FROM f),
 h AS (SELECT *, lag(c2) OVER ({WS}) AS p2 FROM g), k AS (SELECT *, spike OR coalesce(abs(open - p2) > 3 * sc, false) AS bo FROM h)
 SELECT symbol, {ds()} AS session, {rs('c2')} AS close, {rs('CASE WHEN bo THEN coalesce(p2, open) ELSE open END')} AS open FROM k""")
def repair(spark, d):
    r = R.repair_prints(B.daily_bars(spark, d).select("symbol", "session", *OHLC), k_spike=3.0)
    return r.select("symbol", day().alias("session"), rnd("close").alias("close"), rnd("open").alias("open"))


@query("src09_parquet_store", f"""WITH {B.BARS} SELECT symbol, count(*) AS rows, {ds('min(session)')} AS first, {ds('max(session)')} AS last FROM bars WHERE session BETWEEN DATE '1996-03-01' AND DATE '1997-09-30' GROUP BY 1""")
def parquet_store(spark, d):
    """Write by kind and year, read one range back, and list it."""
    path = fresh_path(spark, "store")
    R.write_store(B.daily_bars(spark, d), path, "daily")
    m = R.manifest(R.read_store(spark, path, "daily", "1996-03-01", "1997-09-30"))
    return m.select("symbol", "rows", day("first").alias("first"), day("last").alias("last"))


@query("src18_insider_bulk", """SELECT l_orderkey AS accession, l_suppkey AS issuer_cik, o_custkey AS owner_cik, CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'P' END AS code, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, l_quantity AS shares, count(*) > 0 AS present
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag IN ('R', 'A') GROUP BY ALL""")
def insider_bulk(spark, d):
    """Three tab-separated files written from the tables, read back as text, joined and typed."""
    li, o = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    dm = lambda c: F.upper(F.date_format(c, "dd-MMM-yyyy"))
    code = F.when(F.col("l_returnflag") == "R", "S").when(F.col("l_returnflag") == "A", "P").otherwise("X")
    trn = li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("ACCESSION_NUMBER"), code.alias("TRANS_CODE"), F.lit("A").alias("TRANS_ACQUIRED_DISP_CD"),
                    dm("l_shipdate").alias("TRANS_DATE"), F.col("l_quantity").alias("TRANS_SHARES"), F.lit(10.0).alias("TRANS_PRICEPERSHARE"))
    keys = li.select("l_orderkey", "l_suppkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    acc = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("ACCESSION_NUMBER")
    sub = keys.select(acc, F.when(F.col("o_orderstatus") == "P", "4/A").otherwise("4").alias("DOCUMENT_TYPE"), dm("o_orderdate").alias("FILING_DATE"), F.col("l_suppkey").alias("ISSUERCIK"),
                      F.concat(F.lit(' "m'), F.col("l_suppkey")).alias("ISSUERTRADINGSYMBOL"))
    own = keys.select(acc, F.col("o_custkey").alias("RPTOWNERCIK"), F.lit("Director").alias("RPTOWNER_RELATIONSHIP"))
    read = []
    for n, t in (("trn", trn), ("sub", sub), ("own", own)):
        path = fresh_path(spark, n)
        t.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
        read.append(R.read_tsv(spark, path, t.columns))
    x = R.insider_bulk(*read)
    return x.select(F.split_part("accession", F.lit("-"), F.lit(1)).cast("bigint").alias("accession"), "issuer_cik", "owner_cik", "code", day("filing_date").alias("filing_date"), "shares").distinct().withColumn("present", F.lit(True))


@query("src19_form4_xml", f"""SELECT l_orderkey AS doc_id, l_suppkey AS symbol, {ds('l_shipdate')} AS date, {rs("CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END", 2)} AS shares, count(*) AS n FROM lineitem GROUP BY ALL""")
def form4_xml(spark, d):
    li = B.table(spark, d, "lineitem")
    v = lambda tag, x: F.concat(F.lit(f"<{tag}><value>"), x, F.lit(f"</value></{tag}>"))
    side = F.when(F.col("l_returnflag") == "R", "D").otherwise("A")
    tx = F.concat(F.lit("<nonDerivativeTransaction>"), v("transactionDate", F.date_format("l_shipdate", "yyyy-MM-dd")), F.lit("<transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts>"),
                  v("transactionShares", F.col("l_quantity").cast("string")), v("transactionPricePerShare", F.lit("2.5")), v("transactionAcquiredDisposedCode", side),
                  F.lit("</transactionAmounts><postTransactionAmounts>"), v("sharesOwnedFollowingTransaction", F.lit("50000")), F.lit("</postTransactionAmounts></nonDerivativeTransaction>"))
    doc = li.groupBy("l_orderkey", "l_suppkey").agg(F.array_join(F.array_agg(tx), "").alias("t"))
    head = ("</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>A Person</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector>"
            "<isOfficer>true</isOfficer><officerTitle>Treasurer</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>")
    doc = doc.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("<ownershipDocument><issuer><issuerTradingSymbol>"), F.col("l_suppkey"), F.lit(head), F.col("t"), F.lit("</nonDerivativeTable></ownershipDocument>")).alias("xml"))
    r = R.form4_xml(doc)
    return r.groupBy("doc_id", F.col("symbol").cast("bigint").alias("symbol"), day("date").alias("date"), rnd("shares", 2).alias("shares")).agg(F.count(F.lit(1)).alias("n"))


@query("src21_company_facts", f"""WITH {B.FUNDAMENTALS} SELECT symbol AS cik, {ds('period_end')} AS "end", CASE WHEN income > 100000 THEN 'Income' ELSE 'Revenue' END AS tag, {rs('CASE WHEN income > 100000 THEN income ELSE revenue END', 2)} AS val FROM fun""")
def company_facts(spark, d):
    f = B.fundamentals(spark, d)
    e = lambda v, cond: F.filter(F.array_agg(F.when(cond, F.struct(F.col("period_end").alias("start"), F.col("period_end").alias("end"), F.col(v).alias("val"), F.col("available_at").alias("filed")))), lambda z: z.isNotNull())
    g = f.groupBy("symbol").agg(e("revenue", F.lit(True)).alias("r"), e("income", F.col("income") > 100000).alias("i"))
    node = lambda unit, x: F.struct(F.create_map(F.lit(unit), F.col(x)).alias("units"))
    gaap = F.create_map(F.lit("Revenue"), node("USD", "r"), F.lit("Income"), node("USD/shares", "i"))
    docs = g.select(F.col("symbol").alias("cik"), F.to_json(F.struct(F.struct(gaap.alias("us-gaap")).alias("facts"))).alias("facts"))
    r = R.facts(docs, ["Income", "Revenue"])
    return r.select("cik", day("end").alias("end"), "tag", rnd("val", 2).alias("val"))


@query("src16_report_calendar", f"""SELECT concat('S', l_suppkey) AS symbol, {ds('l_shipdate')} AS date, CASE min(l_linenumber) % 3 WHEN 0 THEN 'bmo' WHEN 1 THEN 'amc' ELSE 'unknown' END AS timing, concat('Q', quarter(l_shipdate)) AS fq
 FROM lineitem GROUP BY l_suppkey, l_shipdate""")
def report_calendar(spark, d):
    """A file of reports for each ship date, named by the day."""
    g = B.table(spark, d, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.min("l_linenumber").alias("m"))
    time = F.when(F.col("m") % 3 == 0, "time-pre-market").when(F.col("m") % 3 == 1, "time-after-hours").otherwise("time-not-supplied")
    row = F.struct(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), time.alias("time"), F.concat(F.lit("Q"), F.quarter("day")).alias("fq"))
    path = fresh_path(spark, "calendar")
    g.groupBy("day").agg(F.to_json(F.array_agg(row)).alias("value")).repartition(8, "day").write.partitionBy("day").text(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in fs.globStatus(hadoop(f"{path}/day=*/part-*")):  # a file a day of the calendar
        day_ = part.getPath().getParent().getName().split("=")[1]
        fs.rename(part.getPath(), hadoop(f"{path}/{day_}.json"))
    return R.report_calendar(spark, f"{path}/*.json").select("symbol", day("date").alias("date"), "timing", "fq")


ACCEPTED = "CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST((o_orderkey * 37) % 1700 AS INTEGER))"


@query("src17_result_filings", f"""WITH f AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE timezone('America/New_York', timezone('UTC', {ACCEPTED})) END AS acc FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 3 <> 0 AND o_orderdate >= DATE '1993-06-01')
 SELECT DISTINCT cik, {ds('date')} AS date, CASE WHEN acc IS NULL OR CAST(acc AS DATE) <> date THEN 'unknown' WHEN hour(acc) * 60 + minute(acc) < 570 THEN 'bmo' WHEN hour(acc) >= 16 THEN 'amc' ELSE 'intraday' END AS timing FROM f""")
def result_filings(spark, d):
    """Filings of each customer as parallel arrays: forms, dates, times of acceptance and items."""
    o = B.table(spark, d, "orders")
    form = F.when(F.col("o_orderpriority") == "5-LOW", "10-Q").when(F.col("o_orderkey") % 2 == 0, "8-K/A").otherwise("8-K")
    at = F.to_date("o_orderdate").cast("timestamp") + F.make_interval(mins=((F.col("o_orderkey") * 37) % 1700).cast("int"))
    f = o.select("o_custkey", form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("acceptanceDateTime"),
                 F.when(F.col("o_orderkey") % 3 == 0, "5.07").otherwise("2.02,9.01").alias("items"))
    names = ("form", "filingDate", "acceptanceDateTime", "items")
    g = f.groupBy(F.col("o_custkey").alias("cik")).agg(F.array_agg(F.struct(*names)).alias("a"))
    path = fresh_path(spark, "submissions")
    g.select("cik", F.struct(F.struct(*[F.col("a")[x].alias(x) for x in names]).alias("recent")).alias("filings")).write.json(path)
    return R.result_filings(spark, path, "1993-06-01").select("cik", day("date").alias("date"), "timing")


def holdings_documents(spark, d):
    """A holdings report for each order; half carry a prefix on all names, and every fiftieth is cut off."""
    li = B.table(spark, d, "lineitem")
    p = F.when(F.col("l_orderkey") % 2 == 1, "n1:").otherwise("")
    tag = lambda name, x: F.concat(F.lit("<"), p, F.lit(f"{name}>"), x, F.lit("</"), p, F.lit(f"{name}>"))
    option = F.when(F.col("l_linenumber") % 4 == 0, tag("putCall", F.lit("Put"))).otherwise("")
    row = tag("infoTable", F.concat(tag("nameOfIssuer", F.concat(F.lit("Maker "), "l_suppkey")), tag("cusip", F.concat(F.lit("C"), "l_suppkey")), tag("value", F.col("l_extendedprice").cast("string")),
                                    tag("shrsOrPrnAmt", tag("sshPrnamt", F.col("l_quantity").cast("string"))), option))
    doc = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.array_agg(row), "").alias("t"))
    p = F.when(F.col("doc_id") % 2 == 1, "n1:").otherwise("")
    space = F.when(F.col("doc_id") % 2 == 1, " xmlns:n1=\"urn:holdings\"").otherwise("")
    end = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.concat(F.lit("</"), p, F.lit("informationTable>")))
    return doc.select("doc_id", F.concat(F.lit("<"), p, F.lit("informationTable"), space, F.lit(">"), "t", end).alias("xml"))


@query("src20_holdings_xml", f"""SELECT l_orderkey AS doc_id, concat('C', l_suppkey) AS cusip, {rs('l_extendedprice', 2)} AS value, {rs('l_quantity', 2)} AS shares, count(*) AS n FROM lineitem WHERE l_orderkey % 50 <> 0 AND l_linenumber % 4 <> 0 GROUP BY 1, 2, 3, 4""")
def holdings_xml(spark, d):
    h = R.holdings_xml(holdings_documents(spark, d))
    return h.groupBy("doc_id", "cusip", rnd("value", 2).alias("value"), rnd("shares", 2).alias("shares")).agg(F.count("*").alias("n"))


@query("src20_broken_documents", "SELECT DISTINCT l_orderkey AS doc_id, true AS broken FROM lineitem WHERE l_orderkey % 50 = 0")
def broken_documents(spark, d):
    return R.broken_documents(holdings_documents(spark, d)).withColumn("broken", F.lit(True))


@query("jon21_security_tickers", f"""WITH m AS (SELECT concat('C', s_suppkey) AS cusip, concat('T', s_nationkey, '.', s_suppkey) AS ticker FROM supplier WHERE s_suppkey % 7 <> 0)
 SELECT l_orderkey AS doc_id, ticker, {rs('sum(l_extendedprice)', 2)} AS value, count(*) AS positions FROM lineitem LEFT JOIN m ON cusip = concat('C', l_suppkey) WHERE l_orderkey % 50 <> 0 AND l_linenumber % 4 <> 0 GROUP BY 1, 2""")
def security_tickers(spark, d):
    m = B.table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(F.concat(F.lit("C"), "s_suppkey").alias("cusip"), F.concat(F.lit("T"), "s_nationkey", F.lit("."), "s_suppkey").alias("ticker"))
    h = R.with_tickers(R.holdings_xml(holdings_documents(spark, d)), m)
    return h.groupBy("doc_id", "ticker").agg(rnd(F.sum("value"), 2).alias("value"), F.count("*").alias("positions"))


@query("src12_universe_load", f"""SELECT s_suppkey AS symbol, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey) AS loaded FROM supplier""")
def universe_load(spark, d):
    have = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol")).distinct()
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"))
    ok = s.join(have, "symbol", "left_semi").withColumn("loaded", F.lit(True))
    return ok.unionByName(s.join(have, "symbol", "left_anti").withColumn("loaded", F.lit(False)))


@query("src24_missing_weeks", f"""WITH w AS (SELECT s_suppkey AS symbol, CAST(unnest(generate_series(date_trunc('week', DATE '1998-01-01')::TIMESTAMP, TIMESTAMP '1998-03-31', INTERVAL 7 DAY)) AS DATE) AS week FROM supplier),
 l AS (SELECT DISTINCT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS week FROM lineitem) SELECT symbol, {ds('week')} AS week FROM w ANTI JOIN l USING (symbol, week)""")
def missing_weeks(spark, d):
    done = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("week")).distinct()
    return R.missing_weeks(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol")), "1998-01-01", "1998-03-31", done).select("symbol", day("week").alias("week"))


@query("src39_experiment_log", "SELECT l_returnflag AS component, count(DISTINCT l_linenumber * 100 + CAST(l_tax * 100 AS INTEGER)) AS variants FROM lineitem GROUP BY 1")
def experiment_log(spark, d):
    li = B.table(spark, d, "lineitem")
    rows = li.select(F.lit("study").alias("phase"), F.col("l_returnflag").alias("component"), F.col("l_linenumber").cast("string").alias("variant"),
                     F.create_map(F.lit("tax"), F.format_string("%.2f", "l_tax")).alias("params"), F.lit("train").alias("segment"), F.create_map(F.lit("n"), F.col("l_quantity")).alias("metrics"))
    path = fresh_path(spark, "experiments")
    R.log_experiments(rows, path)
    return R.variants_tried(R.read_experiments(spark, path))


@query("set01_merge_reports", f"""WITH a AS (SELECT DISTINCT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, CASE l_returnflag WHEN 'R' THEN 'bmo' WHEN 'A' THEN 'amc' ELSE 'unknown' END AS timing, 'a' AS src FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE), CASE l_returnflag WHEN 'R' THEN 'bmo' WHEN 'A' THEN 'amc' ELSE 'unknown' END, 'b' FROM lineitem WHERE l_linestatus = 'F')
 SELECT symbol, {ds('date')} AS date, CASE WHEN count(DISTINCT timing) FILTER (timing <> 'unknown') = 1 THEN max(timing) FILTER (timing <> 'unknown') ELSE 'unknown' END AS timing, CASE WHEN count(DISTINCT src) = 2 THEN 'both' ELSE max(src) END AS source FROM a GROUP BY 1, a.date""")
def merge_reports(spark, d):
    li = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"),
                                              F.when(F.col("l_returnflag") == "R", "bmo").when(F.col("l_returnflag") == "A", "amc").otherwise("unknown").alias("timing"), "l_linestatus")
    m = R.merge_reports(li.where(F.col("l_linestatus") == "O"), li.where(F.col("l_linestatus") == "F"))
    return m.select("symbol", day("date").alias("date"), "timing", "source")


@query("src36_upsert", "SELECT c_custkey AS symbol, CASE WHEN c_acctbal > 5000 THEN upper(c_name) ELSE c_name END AS name FROM customer")
def upsert(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name"), F.lit(1).alias("version"), "c_acctbal")
    new = c.where(F.col("c_acctbal") > 5000).withColumns({"name": F.upper("name"), "version": F.lit(2)})
    return R.upsert_latest(c.drop("c_acctbal"), new.drop("c_acctbal"), ["symbol"], "version").select("symbol", "name")


@query("jon29_best_source", """WITH s AS (SELECT l_suppkey AS symbol, l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS pr FROM lineitem) SELECT symbol, l_orderkey, l_linenumber, l_partkey, pr FROM s QUALIFY pr = min(pr) OVER (PARTITION BY symbol)""")
def best_source(spark, d):
    li = B.table(spark, d, "lineitem")
    s = li.select(F.col("l_suppkey").alias("symbol"), "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("pr"))
    return J.best_source_rows(s, "symbol", "pr")


@query("jon31_layered_resolution", """WITH c AS (SELECT o_custkey AS name, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS layer FROM orders) SELECT name, arg_min(id, (layer, id)) AS id, min(layer) AS layer FROM c GROUP BY 1""")
def layered_resolution(spark, d):
    o = B.table(spark, d, "orders")
    c = o.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3).alias("layer"))
    return J.pick_by_layer(c, ["name"], "layer", ["id"])


@query("prj06_segments", f"""WITH {B.BARS} SELECT CASE WHEN session <= DATE '1996-12-31' THEN 'train' ELSE 'validation' END AS segment, count(*) AS n FROM bars WHERE session BETWEEN DATE '1995-06-01' AND DATE '1998-12-31' GROUP BY 1""")
def segments(spark, d):
    b = B.daily_bars(spark, d).select("symbol", "session")
    dim = B.table(spark, d, "region").limit(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("date").alias("lo"), F.lit(z).cast("date").alias("hi")) for n, a, z in (
        ("train", "1995-06-01", "1996-12-31"), ("validation", "1997-01-01", "1998-12-31"), ("test", "1999-01-01", "2001-12-31"))])).alias("z")).select("z.*")
    return R.clip_segment(b, dim, ["train", "validation"]).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
