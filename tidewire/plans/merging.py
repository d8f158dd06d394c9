"""Stories by leader clustering, their merge log and the diverse brief; order-dependent, so tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, stories
from ..operators.graph import written
from .items import NOW
from .queries import Query, _scored


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = _scored(spark, sf_dir)
    placed = written(clusters.clustered(items))
    return stories.story_records(items.join(placed.select("id", F.col("story_id").alias("story_key")), "id"), NOW), placed


def merged_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = _merged(spark, sf_dir)
    return records.select(F.col("story_key").alias("story_id"), "primary_id", "title", "item_count", "score", "category", F.array_join("reasons", "|").alias("reasons"), "earliest_at", "latest_at")


def merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.merge_log(clusters.clustered(_scored(spark, sf_dir)))


def diverse_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief: stories that pass its gate, spread over sources."""
    records, _ = _merged(spark, sf_dir)
    gated = stories.passing_brief(records).select(F.col("story_key").alias("story_id"), "title", "source", "score", "item_count", "category")
    return gated.join(F.broadcast(clusters.diverse(gated, 20)), "story_id")


#: name: (query, SQL or None)
MERGING: dict[str, tuple[Query, str | None]] = {"merged_stories": (merged_stories, None), "merge_log": (merge_log, None), "diverse_brief": (diverse_brief, None)}
