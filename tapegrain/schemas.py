"""Explicit schemas of the core tables as DDL text; readers never infer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


BARS = ("symbol STRING, resolution STRING, ts TIMESTAMP, session DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
          "volume DOUBLE, vwap DOUBLE, t_close TIMESTAMP")
CALENDAR = ("session DATE, ord INT, open_ts TIMESTAMP, close_ts TIMESTAMP, early_close BOOLEAN")
MEMBERSHIP = ("ticker STRING, start DATE, end DATE, key STRING")
FUNDAMENTALS = ("symbol STRING, period_end DATE, available_at DATE, metric STRING, value DOUBLE")
INSIDER_TX = ("accession STRING, filing_date DATE, trans_date DATE, issuer_cik BIGINT, issuer_name STRING, issuer_symbol STRING, owner_cik BIGINT, "
                "relationship STRING, title STRING, code STRING, acq_disp STRING, shares DOUBLE, price DOUBLE, value DOUBLE, planned_10b5_1 BOOLEAN")
ARTICLES = ("id STRING, title STRING, summary STRING, url STRING, source STRING, published_at TIMESTAMP, tickers ARRAY<STRING>")
TRANSACTIONS = ("portfolio STRING, symbol STRING, side STRING, qty DECIMAL(20,8), price DECIMAL(18,6), fee DECIMAL(18,6), executed_at TIMESTAMP")
PREDICTIONS = ("id BIGINT, symbol STRING, horizon INT, created_at TIMESTAMP, target_ts TIMESTAMP, point DOUBLE, p10 DOUBLE, p90 DOUBLE, "
                 "contributions MAP<STRING,DOUBLE>")
DECISIONS = ("id BIGINT, created_at TIMESTAMP, symbol STRING, as_of DATE, kind STRING, decision STRING, size_multiplier DOUBLE, risks ARRAY<STRING>")
TRIGGERS = ("trigger_id BIGINT, symbol STRING, kind STRING, level DOUBLE")
CHART_PAYLOAD = ("chart STRUCT<result: ARRAY<STRUCT<meta: STRUCT<symbol: STRING, exchangeTimezoneName: STRING>, timestamp: ARRAY<BIGINT>, indicators: STRUCT<"
                 "quote: ARRAY<STRUCT<open: ARRAY<DOUBLE>, high: ARRAY<DOUBLE>, low: ARRAY<DOUBLE>, close: ARRAY<DOUBLE>, volume: ARRAY<DOUBLE>>>, adjclose: ARRAY<STRUCT<adjclose: ARRAY<DOUBLE>>>>>>>")
_V = "STRUCT<value: {}>".format
OWNERSHIP = ("issuer STRUCT<issuerTradingSymbol: STRING>, reportingOwner ARRAY<STRUCT<reportingOwnerId: STRUCT<rptOwnerName: STRING>, "
             "reportingOwnerRelationship: STRUCT<isDirector: STRING, isOfficer: STRING, isTenPercentOwner: STRING, officerTitle: STRING>>>, "
             f"nonDerivativeTable STRUCT<nonDerivativeTransaction: ARRAY<STRUCT<transactionDate: {_V('STRING')}, transactionCoding: STRUCT<transactionCode: STRING>, "
             f"transactionAmounts: STRUCT<transactionShares: {_V('DOUBLE')}, transactionPricePerShare: {_V('DOUBLE')}, transactionAcquiredDisposedCode: {_V('STRING')}>, "
             f"postTransactionAmounts: STRUCT<sharesOwnedFollowingTransaction: {_V('DOUBLE')}>>>>")
COMPANY_FACTS = ("facts STRUCT<`us-gaap`: MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<start: DATE, end: DATE, val: DOUBLE, accn: STRING, fy: INT, fp: STRING, form: STRING, filed: DATE, frame: STRING>>>>>>")
SUBMISSIONS = ("cik BIGINT, filings STRUCT<recent: STRUCT<form: ARRAY<STRING>, filingDate: ARRAY<STRING>, acceptanceDateTime: ARRAY<STRING>, items: ARRAY<STRING>>>")
HOLDINGS = ("infoTable ARRAY<STRUCT<nameOfIssuer: STRING, cusip: STRING, value: STRING, shrsOrPrnAmt: STRUCT<sshPrnamt: STRING>, putCall: STRING>>, _corrupt STRING")
PAGED_BARS = ("symbol STRING, next_page STRING, bars ARRAY<STRUCT<t:DATE,o:DOUBLE,h:DOUBLE,l:DOUBLE,c:DOUBLE,v:DOUBLE>>")
EXPERIMENT = ("phase STRING, component STRING, variant STRING, params MAP<STRING,STRING>, segment STRING, metrics MAP<STRING,DOUBLE>")


def require(df: DataFrame, ddl: str) -> DataFrame:
    """Check names and types at a stage boundary and put the columns in the declared order."""
    schema = T.StructType.fromDDL(ddl)
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bad = [f.name for f in schema.fields if have.get(f.name) != f.dataType.simpleString()]
    if bad:
        raise TypeError(f"columns missing or of another type: {bad}")
    return df.select(*[f.name for f in schema.fields])
