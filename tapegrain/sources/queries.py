"""Filtered reads whose predicates reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def disclosed_trades(trades: DataFrame, issuer: int | None = None, role: str | None = None, side: str | None = None,
                     since: str | None = None, limit: int | None = None) -> DataFrame:
    """Disclosed trades by optional filters, newest filing first."""
    d = trades
    if issuer is not None:
        d = d.where(F.col("issuer") == issuer)
    if role:
        d = d.where(F.contains(F.lower("role"), F.lit(role.lower())))
    if side:
        d = d.where(F.col("code").startswith(side))
    if since:
        d = d.where(F.col("filed") >= F.lit(since).cast("date"))
    d = d.orderBy(F.desc("filed"), F.desc("value"), "issuer", "owner")
    return d.limit(limit) if limit else d


def search_instruments(queries: DataFrame, instruments: DataFrame, limit: int = 20) -> DataFrame:
    """Rank instruments for each query text: exact symbol, prefix, infix, then the name.

    Symbols and names are posted under their distinct pieces of up to three characters; a query looks up its
    first piece and only the instruments posted there are compared. Empty queries find nothing.
    """
    from pyspark.sql import Window
    q = queries.select("query", F.upper("query").alias("_q")).distinct().where(F.length("_q") > 0)
    q = q.withColumn("_g", F.substring("_q", 1, 3))
    sizes = [r[0] for r in q.select(F.length("_g")).distinct().collect()]  # of 1, 2, 3
    sym, name = F.upper(F.col("symbol")), F.upper(F.col("name"))
    grams = lambda x, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substr(x, i, F.lit(n)))
    posted = F.array_distinct(F.flatten(F.array(*[grams(x, n) for x in (F.coalesce(sym, F.lit("")), F.coalesce(name, F.lit(""))) for n in sizes]))) if sizes else F.array().cast("array<string>")
    score = (F.when(sym == F.col("_q"), 100).when(sym.startswith(F.col("_q")), 80).when(F.contains(sym, F.col("_q")), 60)
             .when(name.startswith(F.col("_q")), 50).when(F.contains(name, F.col("_q")), 30).otherwise(0))
    j = instruments.withColumn("_g", F.explode(posted)).join(q, "_g").withColumn("score", score).where(F.col("score") > 0).drop("_g")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "symbol")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("_q")
