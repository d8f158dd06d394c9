"""Counts and comparisons over scored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site_statistics(items: DataFrame, related: Column) -> DataFrame:
    """Raw and related items of each site, and the share in percent."""
    return items.groupBy("site_id").agg(F.count("*").alias("raw_count"), F.count_if(related).alias("kept_count")).withColumn(
        "kept_percent", F.round(F.col("kept_count") * 100.0 / F.col("raw_count"), 1)
    )


def source_audit(items: DataFrame, related: Column, truth: Column, score: Column) -> DataFrame:
    """Per source: all, kept, true and wrongly kept items, the mean score, and what to do with the source."""
    out = items.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(related).alias("kept"), F.count_if(truth).alias("hits"), F.count_if(related & ~F.coalesce(truth, F.lit(False))).alias("noise"), F.avg(score).alias("mean_score")
    )
    rate = F.col("kept") / F.col("total")
    return out.withColumn("action", F.when((F.col("total") >= 20) & (rate < 0.05), "delete").when((F.col("total") >= 20) & (rate < 0.3), "throttle").otherwise("keep"))


def scoring_changes(items: DataFrame, key: Column, before: tuple[Column, Column], after: tuple[Column, Column]) -> DataFrame:
    """Per key: items, kept by each of two (kept, label) scorers, dropped and added ones, and label moves."""
    (kept_a, label_a), (kept_b, label_b) = before, after
    return items.groupBy(key.alias("key")).agg(
        F.count("*").alias("total"), F.count_if(kept_a).alias("kept_before"), F.count_if(kept_b).alias("kept_after"), F.count_if(kept_a & ~kept_b).alias("dropped"),
        F.count_if(~kept_a & kept_b).alias("added"), F.count_if(kept_a & kept_b & (label_a != label_b)).alias("moved"),
    )


def spark_line(events: DataFrame, key: str, at: Column, now: Column, buckets: int = 12, hours: int = 24) -> DataFrame:
    """(key, bucket, n): events of each key in equal buckets up to now, empty ones included."""
    age = (F.unix_micros(now) - F.unix_micros(at)) / 3.6e9
    seen = events.where((age >= 0) & (age < hours)).groupBy(key, (F.lit(buckets - 1) - F.floor(age * buckets / hours)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    grid = events.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return grid.join(seen, [key, "bucket"], "left").na.fill(0, ["n"])


def section_counts(items: DataFrame, section: Column) -> DataFrame:
    """Items of each section, and of all under "all"."""
    return items.rollup(section.alias("section")).agg(F.count("*").alias("n")).select(F.coalesce("section", F.lit("all")).alias("section"), "n")


def label_moves(items: DataFrame, before: tuple[Column, Column], after: tuple[Column, Column], most: int = 20) -> DataFrame:
    """(label_before, label_after, n): the commonest changes of label among items that both (kept, label) scorers keep."""
    (kept_a, label_a), (kept_b, label_b) = before, after
    rows = items.where(kept_a & kept_b & (label_a != label_b))
    return rows.groupBy(label_a.alias("label_before"), label_b.alias("label_after")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label_before", "label_after").limit(most)


def flips(items: DataFrame, kept_before: Column, kept_after: Column, most: int = 30) -> DataFrame:
    """The first `most` items, by id, that only the first scorer keeps ("dropped"), and as many that only the second one does ("added")."""
    of = lambda test, name: items.where(test).orderBy("id").limit(most).withColumn("flip", F.lit(name))
    return of(kept_before & ~kept_after, "dropped").union(of(~kept_before & kept_after, "added"))


def relevance_audit(items: DataFrame, least: float = 0.45, threshold: float = 0.65, most: int = 20) -> DataFrame:
    """(part, name, n, share): items by label, kept ones and their share by site, and the `most` best-scored items under the threshold."""
    by = lambda part, key, *more: items.groupBy(key.alias("name")).agg(*more).select(F.lit(part).alias("part"), "name", "n", "share")
    none = F.max(F.lit(None).cast("double")).alias("share")
    labels = by("label", F.coalesce("ai_label", F.lit("unknown")), F.count("*").alias("n"), none)
    sites = by("site", F.col("site_id"), F.count_if("ai_is_related").alias("n"), F.round(F.count_if("ai_is_related") / F.count("*"), 4).alias("share"))
    band = items.where((F.col("ai_score") >= least) & (F.col("ai_score") < threshold)).orderBy(F.desc("ai_score"), "id").limit(most)
    return labels.union(sites).union(band.select(F.lit("review"), F.col("id"), F.lit(1).cast("bigint"), F.col("ai_score")))
