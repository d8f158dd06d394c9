"""Whether an item is told elsewhere: by URL, or by a title that shares most of its words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigram_tokens
from ..functions.urls import normalized
from .graph import written
from .sets import alike_sets

#: Fixed value: least Jaccard of two titles.
LEAST = 0.6


def keyed(items: DataFrame) -> DataFrame:
    """(id, site_id, url, tokens) of items, URLs normalized and titles as sets of words, sorted."""
    return items.select("id", F.coalesce("site_id", F.lit("unknown")).alias("site_id"), normalized(F.coalesce("url", F.lit(""))).alias("url"), F.array_sort(bigram_tokens(F.coalesce("title", F.lit("")))).alias("tokens"))


def told_elsewhere(items: DataFrame, others: DataFrame, across_sites: bool = False, common: int | None = None) -> DataFrame:
    """(id) of keyed items that match one of the others, of another site only if `across_sites`.

    Titles of the same words are one set, and a set knows its least and
    greatest site alone, so copies of a title, and of a URL, cost one row.
    With `common`, words in more of the others than that lead to no comparison,
    though they count in it.
    """
    spread = [F.min("site_id").alias("a"), F.max("site_id").alias("b")]
    elsewhere = (F.col("a") != F.col("site_id")) | (F.col("b") != F.col("site_id")) if across_sites else F.lit(True)
    same = items.where("url <> ''").join(others.where("url <> ''").groupBy("url").agg(*spread).hint("merge"), "url").where(elsewhere).select("id")
    held = written(others.where(F.size("tokens") > 0).groupBy(F.col("tokens").alias("other")).agg(*spread, F.count("*").alias("n")))
    pairs = alike_sets(items.select(F.col("tokens").alias("words")).distinct(), held.select(F.col("other").alias("words")), LEAST)
    if common is not None:
        rare = held.select("n", F.explode("other").alias("w")).groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") <= common).select("w")
        told = pairs.select("words", "other", F.explode(F.array_intersect("words", "other")).alias("w"))
        pairs = told.join(rare, "w", "left_semi").select("words", "other").distinct()
    met = pairs.join(held.hint("merge"), "other").groupBy("words").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    alike = items.join(met.hint("merge"), F.col("tokens") == F.col("words")).where(elsewhere).select("id")
    return same.union(alike).distinct()


def chosen_keys(stories: DataFrame, members: DataFrame, brief: DataFrame) -> DataFrame:
    """(id, url) of the members of stories that two sites tell, or that are in the brief (story_id)."""
    told = members.groupBy("story_id").agg((F.min("site_id") != F.max("site_id")).alias("shared")).where("shared").select("story_id")
    ids = stories.join(told.hint("merge"), "story_id", "left_semi").select("story_id").union(brief.select("story_id")).distinct()
    return members.join(ids.hint("merge"), "story_id", "left_semi").select(F.col("id").cast("string").alias("id"), normalized(F.coalesce("url", F.lit(""))).alias("url"))


def source_quality(items: DataFrame, truth: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per site: items, kept ones, those that the trusted site tells too, that no other site tells, that were chosen, and their mean importance.

    items: id, site_id, title, url, related, importance; truth: items of the
    trusted site; chosen: (id, url). The flags of an id are one row, joined by
    id, then one aggregate goes over sites. No side of a join is broadcast, as
    each grows with the items.
    """
    mine, chosen = written(keyed(items)), written(chosen)
    flag = lambda df, name: df.select("id", *(F.lit(name == x).alias(x) for x in ("hit", "elsewhere", "picked")))
    hit = flag(told_elsewhere(mine, written(keyed(truth))), "hit")
    elsewhere = flag(told_elsewhere(mine, mine, across_sites=True), "elsewhere")
    by_id = mine.join(chosen.select("id").hint("merge"), "id", "left_semi").select("id")
    by_url = mine.where("url <> ''").join(chosen.select("url").distinct().hint("merge"), "url", "left_semi").select("id")
    flags = hit.union(elsewhere).union(flag(by_id.union(by_url), "picked")).groupBy("id").agg(*(F.bool_or(x).alias(x) for x in ("hit", "elsewhere", "picked")))
    rows = items.select("id", F.coalesce("site_id", F.lit("unknown")).alias("site_id"), "related", "importance").join(flags.hint("merge"), "id", "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    return rows.groupBy("site_id").agg(
        F.count("*").alias("total"), F.count_if("related").alias("kept"), F.count_if(on("hit") & (F.col("site_id") != "aihot")).alias("hits"), F.count_if(~on("elsewhere")).alias("exclusive"), F.count_if(on("picked")).alias("chosen"),
        F.round(F.avg("importance"), 4).alias("importance"),
    )


def story_importance(stories: DataFrame, members: DataFrame) -> DataFrame:
    """(site_id, stories, importance): the mean score of the stories that each site tells, each once."""
    pairs = members.select("story_id", "site_id").distinct().join(stories.select("story_id", "score"), "story_id")
    return pairs.groupBy("site_id").agg(F.count("*").alias("stories"), F.round(F.avg("score"), 4).alias("importance"))
