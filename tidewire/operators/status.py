"""How a run's fetches went, and the counts that a snapshot publishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sites whose empty answer is no fault.
OPTIONAL_SITES = ["xapi", "socialdata_x", "tikhub_douyin", "tikhub_xiaohongshu"]


def site_states(statuses: DataFrame) -> DataFrame:
    """statuses (site_id, ok, item_count, skipped) with a state: failed, skipped, empty_optional, empty or fine."""
    none = F.coalesce("item_count", F.lit(0)) == 0
    skipped = F.coalesce("skipped", F.lit(False))
    state = F.when(~F.coalesce("ok", F.lit(False)), "failed").when(skipped, "skipped").when(none & F.col("site_id").isin(OPTIONAL_SITES), "empty_optional").when(none, "empty").otherwise("fine")
    return statuses.withColumn("state", state)


def state_counts(statuses: DataFrame) -> DataFrame:
    """(state, sites, items) of each state; the sites of a state are rows of `site_states`."""
    return site_states(statuses).groupBy("state").agg(F.count("*").alias("sites"), F.sum(F.coalesce("item_count", F.lit(0))).alias("items"))


def feed_summary(feeds: DataFrame) -> DataFrame:
    """One row over feeds (ok, skipped, replaced, item_count, duration_ms)."""
    on = lambda c: F.coalesce(c, F.lit(False))
    return feeds.agg(
        F.count("*").alias("feeds"), F.count_if(~on("skipped")).alias("effective"), F.count_if(on("ok") & ~on("skipped")).alias("fine"), F.count_if(~on("ok")).alias("failed"), F.count_if(on("skipped")).alias("skipped"),
        F.count_if(on("replaced")).alias("replaced"), F.count_if(on("ok") & ~on("skipped") & (F.coalesce("item_count", F.lit(0)) == 0)).alias("empty"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
    )


def site_table(raw: DataFrame, kept: DataFrame, statuses: DataFrame) -> DataFrame:
    """(site_id, site_name, count, raw_count): kept and raw items of every site that has any or was asked, zeros included."""
    names = raw.groupBy("site_id").agg(F.max("site_name").alias("raw_name"), F.count("*").alias("raw_count"))
    own = statuses.groupBy("site_id").agg(F.max("site_name").alias("own_name"))
    counts = kept.groupBy("site_id").agg(F.count("*").alias("count"))
    both = names.join(own, "site_id", "full_outer").join(counts, "site_id", "full_outer")
    return both.select("site_id", F.coalesce("raw_name", "own_name", "site_id").alias("site_name"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("raw_count", F.lit(0)).alias("raw_count"))


def totals(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: raw and kept items, and the distinct sources of kept ones."""
    a = raw.agg(F.count("*").alias("total_raw"))
    b = kept.agg(F.count("*").alias("total"), F.count_distinct(F.concat_ws("::", F.coalesce("site_id", F.lit("")), F.coalesce("source", F.lit("")))).alias("sources"))
    return a.join(b)  # two tables of one row


def status_order(rank: Column) -> list[Column]:
    """How sites are listed: by tier, then share kept, then items, then name."""
    return [rank.asc(), F.desc(F.col("count") / F.greatest(F.lit(1), F.col("raw_count"))), F.desc("count"), F.asc("site_name")]
