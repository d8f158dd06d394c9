"""The given tables as news items, in Spark and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words_of
from ..operators.graph import written

SITES = ["official_ai", "curated_media", "aibase", "opmlrss", "hackernews", "newsnow", "zeli"]
#: Documents appear one a minute from here.
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
START_S = 1704067200
NOW_S = START_S + 86400
NOW = datetime.fromtimestamp(NOW_S, timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SNAPSHOTS: dict[tuple[str, str, str], DataFrame] = {}


def snapshot(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What several queries of one session read of a folder's items: derived and written by the first of them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = written(make(spark, sf_dir))
    return _SNAPSHOTS[key]


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the first line is the title, copies share a URL."""
    docs = table(spark, sf_dir, "documents")
    title = F.left(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.lit(220))
    at = F.timestamp_seconds(F.lit(START_S) + F.col("doc_id") % 1440 * 60)
    return docs.select("doc_id", title.alias("title"), "source", F.element_at(words_of(SITES), (F.col("doc_id") % len(SITES) + 1).cast("int")).alias("site_id")).select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", "site_id", F.col("source").alias("site_name"), "source", "title",
        F.concat(F.lit("https://News.example/"), F.left(F.sha1("title"), F.lit(6)), F.lit("?utm_source=a&id="), F.length("title").cast("string"), F.lit("#top")).alias("url"),
        at.alias("published_at"), at.alias("first_seen_at"), at.alias("event_time"), F.lit(None).cast("double").alias("aihot_score"),
    )


ITEMS_SQL = f"""
items as (
  select cast(doc_id as varchar) as id, doc_id, site_id, source, title,
         'https://news.example/' || substr(sha1(title), 1, 6) || '?id=' || cast(length(title) as varchar) as url,
         {START_S} + (doc_id % 1440) * 60 as at_s
  from (select doc_id, source, left(split_part(coalesce(text, ''), chr(10), 1), 220) as title,
               list_extract({SITES}, cast(doc_id % {len(SITES)} + 1 as integer)) as site_id from documents)
)"""
