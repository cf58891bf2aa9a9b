"""Readers and sinks of landed files: paged and chart JSON, TSV triples, XML, facts, parquet store, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapegrain import schemas as SC
from tapegrain.operators.joins import keep_first


# --- bars ---------------------------------------------------------------------------------------

def by_precedence(feeds: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of feeds in order of trust; per key the row of the most trusted feed."""
    u = None
    for i, f in enumerate(feeds):
        f = f.withColumn("source_rank", F.lit(i))
        u = f if u is None else u.unionByName(f, allowMissingColumns=True)
    rest = [x for x in u.columns if x not in keys]
    g = u.groupBy(*keys).agg(F.min_by(F.struct(*rest), "source_rank").alias("z"))  # combined before the shuffle
    return g.select(*keys, "z.*")


def add_missing(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows plus the extra rows whose key the base lacks."""
    return base.unionByName(extra.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def paged_bars(spark: SparkSession, path: str) -> DataFrame:
    """Landed vendor pages: one JSON document per page with an array of bars."""
    p = spark.read.schema(SC.PAGED_BARS).json(path)
    return p.select("symbol", F.explode("bars").alias("b")).select(
        "symbol", F.col("b.t").alias("session"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"),
        F.col("b.c").alias("close"), F.coalesce("b.v", F.lit(0.0)).alias("volume"))


def chart_bars(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Chart JSON with parallel arrays: prices scaled by adjclose / close, bad bars dropped, last row per day
    of the exchange's own time zone."""
    r = F.from_json(col, SC.CHART_PAYLOAD)["chart"]["result"]
    d = payloads.select(F.get(r, F.lit(0)).alias("r")).where("r.timestamp is not null")
    q, adj = F.get(F.col("r.indicators.quote"), F.lit(0)), F.get(F.col("r.indicators.adjclose"), F.lit(0))["adjclose"]
    arrays = [F.col("r.timestamp").alias("t"), *[q[x].alias(x) for x in ("open", "high", "low", "close", "volume")], adj.alias("adj")]
    d = d.select(F.col("r.meta.symbol").alias("symbol"), F.coalesce("r.meta.exchangeTimezoneName", F.lit("UTC")).alias("zone"), adj.isNotNull().alias("adjusted"), *arrays)
    z = d.select("symbol", "zone", "adjusted", F.posexplode(F.arrays_zip("t", "open", "high", "low", "close", "volume", "adj")).alias("i", "z")).select("symbol", "zone", "adjusted", "i", "z.*")
    f = F.when(F.col("adjusted"), F.col("adj") / F.col("close")).otherwise(1.0)
    z = z.withColumn("_f", f).withColumns({x: F.col(x) * F.col("_f") for x in ("open", "high", "low", "close")})
    z = sane(z.withColumn("session", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("t"), F.col("zone")))))
    return keep_first(z, ["symbol", "session"], [F.desc("i")]).select("symbol", "session", "open", "high", "low", "close", "volume")


def sane(bars: DataFrame) -> DataFrame:
    """Drop bars with missing prices, non-positive close or high below low; missing volume is 0."""
    b = bars.dropna(subset=["open", "high", "low", "close"]).where((F.col("close") > 0) & (F.col("high") >= F.col("low")))
    return b.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def repair_prints(bars: DataFrame, k_spike: float = 8.0, k_wick: float = 6.0, n: int = 63) -> DataFrame:
    """Spike closes become the mean of their neighbours, opens and wicks far off are pulled in.

    The scale is the lagged median of absolute close changes. Two passes: the second reads the
    closes the first repaired. A column counts the repairs per bar.
    """
    w = Window.partitionBy("symbol").orderBy("session")
    d = bars.withColumn("_ac", F.abs(F.col("close") - F.lag("close").over(w)))
    past = w.rowsBetween(-n, -1)
    d = d.withColumns({"_scale": F.when(F.count("_ac").over(past) >= n // 3, F.percentile("_ac", F.lit(0.5)).over(past)),
                       "_p": F.lag("close").over(w), "_n": F.lead("close").over(w)})
    lim = k_spike * F.col("_scale")
    spike = (F.abs(F.col("close") - F.col("_p")) > lim) & (F.abs(F.col("close") - F.col("_n")) > lim) & (F.abs(F.col("_n") - F.col("_p")) < lim / 2)
    spike = F.coalesce(spike, F.lit(False))
    d = d.withColumns({"_fix": spike.cast("int"), "close": F.when(spike, (F.col("_p") + F.col("_n")) / 2).otherwise(F.col("close"))})
    d = d.withColumn("_p", F.lag("close").over(w))
    wick = k_wick * F.col("_scale")
    bad_open = F.coalesce(F.abs(F.col("open") - F.col("_p")) > lim, F.lit(False)) | (F.col("_fix") == 1)
    d = d.withColumns({"_bo": bad_open.cast("int"), "open": F.when(bad_open, F.coalesce("_p", "open")).otherwise(F.col("open"))})
    top, bot = F.greatest("open", "close"), F.least("open", "close")
    hi = F.when(F.col("_scale").isNotNull(), F.greatest(top, F.least(F.col("high"), top + wick))).otherwise(F.greatest("high", top))
    lo = F.when(F.col("_scale").isNotNull(), F.least(bot, F.greatest(F.col("low"), bot - wick))).otherwise(F.least("low", bot))
    d = d.withColumns({"repairs": F.col("_fix") + F.col("_bo") + (hi != F.col("high")).cast("int") + (lo != F.col("low")).cast("int"), "high": hi, "low": lo})
    return d.drop("_ac", "_scale", "_p", "_n", "_fix", "_bo")


def asset_class(symbol: str = "symbol") -> Column:
    s = F.col(symbol)
    return F.when(s.endswith("=X"), "fx").when(s.endswith("-USD") | s.endswith("-USDT"), "crypto").otherwise("equity")


def completed(bars: DataFrame, as_of: Column, t_close: str = "t_close") -> DataFrame:
    """Rows whose bar had closed by ``as_of``: the only rows a decision then may read."""
    return bars.where(F.col(t_close) <= as_of)


def clip_segment(rows: DataFrame, segments: DataFrame, names: list[str], day: str = "session") -> DataFrame:
    """Rows inside the named history segments (a short dim: name, lo, hi)."""
    s = F.broadcast(segments.where(F.col("name").isin(*names)).select("name", "lo", "hi"))
    return rows.join(s, F.col(day).between(F.col("lo"), F.col("hi"))).withColumnRenamed("name", "segment").drop("lo", "hi")


def sessions_from_rows(rows: DataFrame, zone: str = "America/New_York", normal_close: str = "16:00") -> DataFrame:
    """Calendar rows (date, local open, local close) to sessions with UTC times and an early-close flag."""
    at = lambda x: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", "date", x), "yyyy-MM-dd HH:mm"), zone)
    w = Window.partitionBy().orderBy("date")
    return rows.select(F.col("date").cast("date").alias("session"), F.row_number().over(w).alias("ord"), at("open").alias("open_ts"), at("close").alias("close_ts"),
                       (F.col("close") < normal_close).alias("early_close"))


def split_sessions(bars: DataFrame, calendar: DataFrame, minutes: int, zone: str = "America/New_York") -> tuple[DataFrame, DataFrame]:
    """(regular-hours bars, pre-market summary per session); bars of days without a session are dropped."""
    j = bars.withColumn("session", F.to_date(F.from_utc_timestamp("ts", zone))).join(F.broadcast(calendar.select("session", "open_ts", "close_ts")), "session")
    end = F.col("ts") + F.make_interval(mins=F.lit(minutes))
    reg = j.where((F.col("ts") >= F.col("open_ts")) & (end <= F.col("close_ts"))).withColumn("t_close", end)
    pre = j.where(end <= F.col("open_ts")).groupBy("symbol", "session").agg(F.sum("volume").alias("pre_volume"), F.max("high").alias("pre_high"), F.min("low").alias("pre_low"),
                                                                            F.max_by("close", "ts").alias("pre_last"))
    return reg.drop("open_ts", "close_ts"), pre


def hourly_from_open(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """One-hour bars aligned to the session's open; the last one ends at the close."""
    j = bars.join(F.broadcast(calendar.select("session", "open_ts", "close_ts")), "session")
    k = F.floor((F.unix_timestamp("ts") - F.unix_timestamp("open_ts")) / 3600)
    g = j.groupBy("symbol", "session", k.alias("hour")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        (F.sum(F.col("vwap") * F.col("volume")) / F.nullif(F.sum("volume"), F.lit(0.0))).alias("vwap"), F.max("open_ts").alias("_o"), F.max("close_ts").alias("_c"))
    ts = F.timestamp_seconds(F.unix_timestamp("_o") + F.col("hour") * 3600)
    return g.withColumns({"ts": ts, "t_close": F.least(F.timestamp_seconds(F.unix_timestamp("_o") + (F.col("hour") + 1) * 3600), F.col("_c"))}).drop("_o", "_c")


# --- filings ------------------------------------------------------------------------------------

def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text without quoting; everything is text until cast."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path).select(*columns)


def insider_bulk(trn: DataFrame, sub: DataFrame, own: DataFrame) -> DataFrame:
    """Buys and sells of original reports, one row per owner, typed, exact duplicates dropped."""
    t = trn.where(F.col("TRANS_CODE").isin("P", "S"))
    s = sub.where(F.col("DOCUMENT_TYPE") == "4")
    d = t.join(s, "ACCESSION_NUMBER").join(own, "ACCESSION_NUMBER", "left")
    num = lambda x: F.expr(f"try_cast({x} AS DOUBLE)")
    day = lambda x: F.to_date(F.try_to_timestamp(x, F.lit("dd-MMM-yyyy")))
    o = d.select(F.col("ACCESSION_NUMBER").alias("accession"), day("FILING_DATE").alias("filing_date"), day("TRANS_DATE").alias("trans_date"),
                 F.expr("try_cast(ISSUERCIK AS BIGINT)").alias("issuer_cik"), F.upper(F.trim("ISSUERTRADINGSYMBOL")).alias("issuer_symbol"),
                 F.expr("try_cast(RPTOWNERCIK AS BIGINT)").alias("owner_cik"), F.coalesce("RPTOWNER_RELATIONSHIP", F.lit("")).alias("relationship"),
                 F.col("TRANS_CODE").alias("code"), F.col("TRANS_ACQUIRED_DISP_CD").alias("acq_disp"), num("TRANS_SHARES").alias("shares"), num("TRANS_PRICEPERSHARE").alias("price"))
    o = o.withColumn("value", F.col("shares") * F.col("price")).where(F.col("filing_date").isNotNull() & F.col("issuer_cik").isNotNull())
    return o.dropDuplicates(["accession", "owner_cik", "trans_date", "code", "shares", "price"])


def qualifying_purchases(tx: DataFrame) -> DataFrame:
    """Open-market buys by officers or directors, not planned in advance."""
    role = F.contains("relationship", F.lit("Director")) | F.contains("relationship", F.lit("Officer"))
    planned = F.coalesce(F.col("planned_10b5_1"), F.lit(False)) if "planned_10b5_1" in tx.columns else F.lit(False)
    return tx.where((F.col("code") == "P") & (F.col("acq_disp") == "A") & role & ~planned & (F.col("value") > 0) & (F.col("price") > 0))


def form4_xml(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Ownership reports in XML to one row per transaction of the first owner; disposals carry a negative sign."""
    d = docs.withColumn("_f", F.from_xml(F.col(xml), SC.OWNERSHIP)).withColumn("_o", F.get("_f.reportingOwner", F.lit(0)))
    t = d.select("doc_id", F.col("_f.issuer.issuerTradingSymbol").alias("symbol"), F.trim("_o.reportingOwnerId.rptOwnerName").alias("owner"), F.col("_o.reportingOwnerRelationship").alias("rel"),
                 F.explode("_f.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    yes = lambda x: F.trim(f"rel.{x}").isin("1", "true")
    title = F.array_compact(F.array(F.when(yes("isDirector"), "Director"), F.when(yes("isOfficer"), F.coalesce(F.trim("rel.officerTitle"), F.lit("Officer"))), F.when(yes("isTenPercentOwner"), "10% holder")))
    sign = F.when(F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value") == "A", 1.0).otherwise(-1.0)
    shares, price = (F.coalesce(f"t.transactionAmounts.{x}.value", F.lit(0.0)) for x in ("transactionShares", "transactionPricePerShare"))
    return t.select("doc_id", "symbol", "owner", title.alias("titles"), F.to_date("t.transactionDate.value").alias("date"), F.col("t.transactionCoding.transactionCode").alias("code"),
                    (sign * shares).alias("shares"), price.alias("price"), (sign * shares * price).alias("value"),
                    F.coalesce("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value", F.lit(0.0)).alias("shares_owned_after"))


# Units of a figure in order of preference (fixed values).
UNITS = ("USD", "USD/shares", "shares", "USDperShares", "pure")


def facts(docs: DataFrame, tags: list[str], col: str = "facts") -> DataFrame:
    """Company facts to one row per period: synonymous tags in order of preference, first-filed value, the
    preferred unit there is."""
    d = docs.select("cik", F.explode(F.from_json(col, SC.COMPANY_FACTS)["facts"]["us-gaap"]).alias("tag", "node")).where(F.col("tag").isin(*tags))
    held = F.coalesce(*[F.col("node.units")[u] for u in UNITS], F.get(F.filter(F.map_values("node.units"), lambda a: F.size(a) > 0), F.lit(0)))
    e = d.select("cik", "tag", F.explode(held).alias("z")).select("cik", "tag", "z.*")
    rank = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    g = e.groupBy("cik", "start", "end").agg(F.min_by(F.struct("tag", "val", "filed", "fp", "form", "frame"), F.struct(rank, "filed")).alias("z"))
    return g.select("cik", "start", "end", "z.*")


# --- reports and holdings -----------------------------------------------------------------------

# When a report comes out, as the calendar says it (fixed values); anything else is unknown.
REPORT_TIMES = {"time-pre-market": "bmo", "time-after-hours": "amc"}


def report_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, date, timing, fq) from one file a day, an array of reports each; the day is the file's own name."""
    rows = spark.read.schema("symbol string, time string, fq string").option("multiLine", True).json(path)
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})\.json$", 1))
    timing = F.coalesce(*[F.when(F.col("time") == k, v) for k, v in REPORT_TIMES.items()], F.lit("unknown"))
    return rows.select("symbol", day.alias("date"), timing.alias("timing"), "fq").where("symbol is not null")


def result_filings(spark: SparkSession, path: str, since: str, zone: str = "America/New_York") -> DataFrame:
    """(cik, date, timing) of current reports with results, from documents of parallel arrays.

    The time of acceptance, in the exchange's time, tells when the market could know: before 9:30, during the session or from 16:00; it is
    unknown where it is missing or falls on another day than the filing's.
    """
    docs = spark.read.schema(SC.SUBMISSIONS).json(path)
    r = docs.select("cik", F.explode(F.arrays_zip(*[F.col(f"filings.recent.{x}").alias(x) for x in ("form", "filingDate", "acceptanceDateTime", "items")])).alias("z")).select("cik", "z.*")
    r = r.where(F.col("form").startswith("8-K") & F.contains("items", F.lit("2.02")) & (F.col("filingDate") >= since))
    at = F.from_utc_timestamp(F.try_to_timestamp(F.regexp_replace("acceptanceDateTime", "Z$", "")), zone)
    minute = F.hour(at) * 60 + F.minute(at)
    day = F.to_date("filingDate")
    timing = F.when(at.isNull() | (F.to_date(at) != day), "unknown").when(minute < 570, "bmo").when(minute >= 960, "amc").otherwise("intraday")
    return r.select("cik", day.alias("date"), timing.alias("timing")).distinct()


def holdings_xml(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """(doc_id, issuer, cusip, value, shares) of the positions of holdings reports, whatever prefix their names carry; options are left out.

    A document that is no well-formed XML has no positions; ``broken_documents`` lists it.
    """
    t = _holdings(docs, xml).where("_h._corrupt is null").select("doc_id", F.explode("_h.infoTable").alias("t"))
    t = t.where(F.coalesce(F.trim("t.putCall"), F.lit("")) == "")
    number = lambda x: F.coalesce(F.expr(f"try_cast(trim({x}) AS DOUBLE)"), F.lit(0.0))
    text = lambda x: F.coalesce(F.trim(x), F.lit(""))
    return t.select("doc_id", text("t.nameOfIssuer").alias("issuer"), text("t.cusip").alias("cusip"), number("t.value").alias("value"), number("t.shrsOrPrnAmt.sshPrnamt").alias("shares"))


def broken_documents(docs: DataFrame, xml: str = "xml") -> DataFrame:
    return _holdings(docs, xml).where("_h._corrupt is not null or _h is null").select("doc_id")


def _holdings(docs: DataFrame, xml: str) -> DataFrame:
    return docs.withColumn("_h", F.from_xml(F.col(xml), SC.HOLDINGS, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def with_tickers(positions: DataFrame, tickers: DataFrame) -> DataFrame:
    """Positions with the ticker of their security, null where the map has none; of several the first in the alphabet."""
    one = tickers.where("ticker is not null").groupBy("cusip").agg(F.min("ticker").alias("ticker"))
    return positions.join(one, "cusip", "left")


# --- corporate actions --------------------------------------------------------------------------

# Kinds of corporate actions and the fields that any of them may carry, as the vendor names them (fixed values).
ACTION_KINDS = ("cash_dividends", "forward_splits", "reverse_splits", "spin_offs", "cash_mergers", "stock_mergers", "name_changes")
ACTION_FIELDS = ("id string, symbol string, ex_date date, process_date date, effective_date date, rate double, special boolean, old_rate double, new_rate double, "
                 "source_symbol string, source_rate double, old_symbol string, new_symbol string, acquiree_symbol string")


def corporate_actions(spark: SparkSession, path: str) -> DataFrame:
    """Action documents, one per line with a list for each kind, as one row per (kind, id).

    All kinds come from one scan. Documents are merged over batches: of rows with one id the batch last in the order of
    file names wins, and within a document the last row. Rows without an id are told apart by their content.
    """
    schema = ", ".join(f"{k} array<struct<{ACTION_FIELDS.replace(' ', ':').replace(',:', ',')}>>" for k in ACTION_KINDS)
    names = [f.split()[0] for f in ACTION_FIELDS.split(", ")]
    docs = spark.read.schema(schema).json(path).select(F.col("_metadata.file_path").alias("batch"), *ACTION_KINDS)

    def tagged(kind: str):
        return F.transform(kind, lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), r.alias("row")))

    rows = docs.select("batch", F.explode(F.flatten(F.array_compact(F.array(*[tagged(k) for k in ACTION_KINDS])))).alias("z")).select("batch", "z.*")
    rows = rows.withColumn("key", F.coalesce("row.id", F.sha2(F.to_json("row"), 256)))
    last = rows.groupBy("kind", "key").agg(F.max_by("row", F.struct("batch", "place")).alias("row"))
    return last.select("kind", *[F.col("row")[n].alias(n) for n in names])


# --- store, ledgers, logs -----------------------------------------------------------------------

def write_store(df: DataFrame, path: str, kind: str, day: str = "session", key: str = "symbol", mode: str = "overwrite") -> None:
    """Parquet by kind and year. Ranges over (year, key, day) split a large year or a large key over
    many tasks and leave each file with a narrow key range to skip by."""
    (df.withColumns({"kind": F.lit(kind), "year": F.year(day)}).repartitionByRange("year", key, day).sortWithinPartitions("year", key, day).write.mode(mode).option("compression", "zstd").partitionBy("kind", "year").parquet(path))


def read_store(spark: SparkSession, path: str, kind: str, lo: str | None = None, hi: str | None = None, day: str = "session") -> DataFrame:
    """Read a kind; a date range also prunes the year folders."""
    d = spark.read.parquet(path).where(F.col("kind") == kind)
    if lo:
        d = d.where((F.col("year") >= int(lo[:4])) & (F.col(day) >= F.lit(lo).cast("date")))
    if hi:
        d = d.where((F.col("year") <= int(hi[:4])) & (F.col(day) <= F.lit(hi).cast("date")))
    return d.drop("kind", "year")


def manifest(df: DataFrame, key: str = "symbol", day: str = "session") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first"), F.max(day).alias("last"))


def pending(index: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work still to do: index rows without an entry in the ledger."""
    return index.join(done.select(*keys), keys, "left_anti")


def missing_weeks(symbols: DataFrame, start: str, end: str, ledger: DataFrame) -> DataFrame:
    """Weeks to fetch per symbol: the calendar of weeks minus the ledger."""
    w = symbols.select("symbol", F.explode(F.sequence(F.date_trunc("week", F.lit(start).cast("date")).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return pending(w, ledger, ["symbol", "week"])


def log_experiments(rows: DataFrame, path: str) -> None:
    from tapegrain.schemas import require
    require(rows, SC.EXPERIMENT).write.mode("append").json(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SC.EXPERIMENT).json(path)


def variants_tried(log: DataFrame) -> DataFrame:
    """Distinct variants per component, whatever their order of parameters."""
    p = F.to_json(F.array_sort(F.map_entries("params")))
    return log.groupBy("component").agg(F.countDistinct("variant", p).alias("variants"))


def upsert_latest(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union that keeps the newest row per key."""
    u = base.unionByName(changes, allowMissingColumns=True)
    rest = [x for x in u.columns if x not in keys]
    return u.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("z")).select(*keys, "z.*")


def merge_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two report calendars: a known timing beats unknown, two different known timings are unknown."""
    u = a.select("symbol", "date", "timing", F.lit("a").alias("src")).unionByName(b.select("symbol", "date", "timing", F.lit("b").alias("src")))
    known = F.when(F.col("timing") != "unknown", F.col("timing"))
    g = u.groupBy("symbol", "date").agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"), F.min("src").alias("_s0"), F.max("src").alias("_s1"))
    return g.select("symbol", "date", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise("unknown").alias("timing"),
                    F.when(F.col("_s0") != F.col("_s1"), "both").otherwise(F.col("_s0")).alias("source"))
