"""Pages and articles: bodies, publication times, deduplication keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.functions.text import strip_html


def page_bodies(pages: DataFrame, min_chars: int = 500) -> DataFrame:
    """Title, publication time and whole body of each page; the article element where there is one,
    else the page. Short bodies are rejected, long ones are kept whole."""
    art = F.regexp_extract("html", r"(?s)<article[^>]*>(.*?)</article>", 1)
    body = strip_html(F.when(art != "", art).otherwise(F.col("html")))
    p = pages.select("page_id", "url", F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("title"),
                     F.nullif(F.regexp_extract("html", '<time[^>]+datetime="([^"]+)"', 1), F.lit("")).alias("published_at"), body.alias("body"))
    return p.where(F.length("body") >= min_chars)


def articles_to_sessions(articles: DataFrame, published: str, out: str = "session_day", zone: str = "America/New_York") -> DataFrame:
    """Local day an article belongs to: from 16:00 local time on it is the next day."""
    local = F.from_utc_timestamp(published, zone)
    return articles.withColumn(out, F.to_date(local + F.expr("INTERVAL 8 HOURS")))
