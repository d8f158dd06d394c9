"""Stories: items that share one article, as nested records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import importance, site_rank, story_category
from ..functions.text import story_title
from ..functions.urls import canonical

#: What readers see for a category.
CATEGORY_LABELS = {"official": "官方更新", "multi_source": "多源热议", "industry": "行业动态", "watch": "值得关注"}


def by_article(items: DataFrame) -> DataFrame:
    """Adds story_key, the canonical URL or else the title, for `story_records`."""
    url = canonical(F.coalesce("url", F.lit("")))
    return items.withColumn("story_key", F.when(url != "", url).otherwise(story_title(F.coalesce("title", F.lit("")))))


def story_records(items: DataFrame, now: datetime) -> DataFrame:
    """One record for each story_key: primary item, counts, times, source names, score, category and reasons.

    The primary item has the best site tier, then the highest importance, the
    newest time, the first title. Times over ten minutes ahead count as now.
    Everything is a combinable aggregate; only distinct source names are
    gathered.
    """
    copies = items.groupBy("story_key").agg(F.count("*").alias("copies"))
    scored = items.join(copies.hint("merge"), "story_key").withColumn("item_score", importance(now, F.col("copies")))
    primary = F.struct(site_rank(F.col("site_id")), -F.col("item_score"), F.coalesce(-F.unix_micros("event_time"), F.lit(1 << 62)), F.coalesce("title", F.lit("")), "id")
    at = F.when(F.col("event_time") <= F.lit(now) + F.make_dt_interval(mins=F.lit(10)), F.col("event_time")).when(F.col("event_time").isNotNull(), F.lit(now))
    out = scored.groupBy("story_key").agg(
        F.min_by(F.struct("id", "title", "url", "source", "site_id", "site_name", "source_tier", "ai_score", "ai_is_related", "item_score"), primary).alias("main"),
        F.count("*").alias("item_count"),
        F.min(at).alias("earliest_at"),
        F.max(at).alias("latest_at"),
        F.array_sort(F.collect_set(F.coalesce("source", "site_name"))).alias("source_names"),
    )
    score, many = F.col("main.item_score"), F.col("item_count")
    category = story_category(score, F.col("main.source_tier"), many)
    reasons = F.array_compact(F.array(
        F.when(site_rank(F.col("main.site_id")) == 0, F.lit("official_source")), F.when(many >= 2, F.lit("multi_source")),
        F.when(F.col("main.ai_score") >= 0.8, F.lit("high_ai_relevance")), F.when(score >= 0.75, F.lit("high_importance")),
    ))
    label = F.element_at(F.create_map(*(F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair)), F.col("category"))
    return out.select(
        F.concat(F.lit("story_"), F.left(F.sha1(F.concat_ws("\x1f", canonical(F.coalesce("main.url", F.lit(""))), story_title(F.coalesce("main.title", F.lit(""))))), F.lit(12))).alias("story_id"),
        "story_key", F.col("main.id").alias("primary_id"), F.col("main.title").alias("title"), F.col("main.url").alias("url"), "item_count",
        F.col("main.source").alias("source"), score.alias("score"), category.alias("category"), F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("recent_ai_signal"))).alias("reasons"),
        "earliest_at", "latest_at", "source_names",
    ).withColumn("importance_label", label)


def passing_brief(stories: DataFrame) -> DataFrame:
    """Two items or more, or a high score."""
    return stories.where((F.col("item_count") >= 2) | (F.col("score") >= 0.72))


def hotness(age_hours, sources, score):
    """Importance, spread over sources and recency, from 0 to 1."""
    return 0.45 * score + 0.35 * F.least(F.lit(1.0), (sources - 1) / 3) + 0.20 * F.exp(-age_hours / 12)
