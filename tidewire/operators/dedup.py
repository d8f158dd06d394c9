"""Exact and near duplicates of items."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import site_rank, with_creator_ranking, with_relevance, with_tier
from ..functions.text import displayed_source, mergeable, models, repaired, story_title, stripped, title_tokens, vendors
from ..functions.urls import host_of, normalized
from ..functions.vocabulary import CREATOR_SITES
from .graph import written


def tier_order(site: Column | None = None) -> list[Column]:
    """Most authoritative first, then newest, then by title and id."""
    return [site_rank(F.col("site_id") if site is None else site).asc(), F.col("event_time").desc_nulls_last(), F.col("title").asc(), F.col("id").asc()]


def distinct_items(items: DataFrame) -> DataFrame:
    """One row for each title and normalized URL (one site: URL alone): the first by `tier_order`.

    The best row is an aggregate, not a sort of whole groups, so copies are
    combined before the shuffle.
    """
    url = normalized(F.coalesce("url", F.lit("")))
    title = F.when(F.lower(stripped(F.col("site_id"))) == "aihubtoday", F.lit(None)).otherwise(F.lower(stripped(F.coalesce("title", F.lit("")))))
    best = F.struct(site_rank(F.col("site_id")), F.coalesce(-F.unix_micros("event_time"), F.lit(1 << 62)), F.col("title"), F.col("id"))
    picked = items.groupBy(title.alias("_title"), url.alias("_url")).agg(F.min_by(F.struct(*items.columns), best).alias("row"))
    return picked.select("row.*")


def similarity(a: str, b: str, tokens_a: set, tokens_b: set) -> float:
    """Of two titles: matching blocks, lifted by shared tokens; 0 without tokens."""
    if not tokens_a or not tokens_b:
        return 0.0
    sequence = SequenceMatcher(None, a, b).ratio()
    shared = len(tokens_a & tokens_b) / len(tokens_a | tokens_b)
    return round(max(sequence, 0.6 * sequence + 0.4 * shared), 4)


def compatible(a: set, b: set) -> bool:
    """Neither names what the other doesn't, or they share something."""
    return not a or not b or bool(a & b)


class _Kept:
    """The last rows kept of one run of a site, of which at most `look_back` are held."""

    def __init__(self, hours: float, least: float, look_back: int) -> None:
        self.hours, self.least, self.rows = hours, least, deque(maxlen=look_back)

    def loser(self, row) -> object:
        """The id that a new row drops, its own or a kept one's; None if it is new."""
        if row.mergeable:
            for k in range(len(self.rows) - 1, -1, -1):
                other = self.rows[k]
                if (row.at - other.at) / 3.6e9 > self.hours:
                    continue
                union = row.tokens | other.tokens
                if not union or 2 * len(row.tokens & other.tokens) < len(union):
                    continue
                if similarity(row.words, other.words, row.tokens, other.tokens) < self.least:
                    continue
                if compatible(row.vendors, other.vendors) and compatible(row.models, other.models):
                    if (-row.rank, row.score, -row.at) > (-other.rank, other.score, -other.at):
                        self.rows[k] = row
                        return other.id
                    return row.id
        self.rows.append(row)
        return None


#: Rows of a slice of a site (a minute is never cut), and rows before a slice that its look-back is guessed from.
SLICE, WARM = 4096, 240


def _sliced(rows: DataFrame, size: int) -> DataFrame:
    """rows with a slice: numbers from 1 for each site, in the order of time, of about `size` rows."""
    rows = rows.withColumn("minute", F.floor(F.col("at") / 6e7))
    before = Window.partitionBy("site").orderBy("minute")
    minutes = rows.groupBy("site", "minute").count()
    minutes = minutes.withColumn("part", F.floor(F.coalesce(F.sum("count").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / size))
    numbered = minutes.select("site", "minute", F.dense_rank().over(Window.partitionBy("site").orderBy("part")).alias("slice"))
    return rows.join(numbered, ["site", "minute"]).drop("minute")


def without_near_duplicates(items: DataFrame, hours: float = 6.0, least: float = 0.9, look_back: int = 60, slice_rows: int = SLICE, warm: int = WARM) -> DataFrame:
    """items without rewrites of a title on the same site within some hours.

    Each row is compared with the last `look_back` rows kept of its site,
    newest first; the better by tier, score and earlier time stays, in the
    place of the kept one. Rows without an event_time are all kept. items: id,
    site_id, title, event_time, source_tier_rank, ai_score.

    A site is cut into slices that go to tasks by themselves. What a slice
    looks back on is first guessed, by running the rows just before it; each
    slice tells what it was run on and what it leaves. Slices that were run on
    something else than what the one before leaves are run again on that, until
    none is: the same as one pass over the site. Guesses rarely fail, as 60
    kept rows make what came before irrelevant; a slice holds at most that many
    rows beside a batch.
    """
    title = story_title(F.coalesce("title", F.lit("")))
    kind_of_id = items.schema["id"].dataType.simpleString()
    rows = items.where("event_time is not null and id is not null").select(
        F.col("id").cast("string").alias("id"), F.coalesce("site_id", F.lit("")).alias("site"), F.unix_micros("event_time").alias("at"), title.alias("words"),
        title_tokens(title).alias("tokens"), mergeable(title).alias("mergeable"), vendors(title).alias("vendors"), models(title).alias("models"),
        F.coalesce("source_tier_rank", F.lit(99)).cast("int").alias("rank"), F.coalesce(F.col("ai_score").cast("double"), F.lit(0.0)).alias("score"),
    )
    rows = written(_sliced(rows, slice_rows))
    carried = [c for c in rows.columns if c not in ("site", "slice")]
    state = "array<struct<" + ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in carried) + ">>"
    reach = hours * 3.6e9
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept, used, gone, began, out = None, None, None, [], 0, []

        def told():
            return (*at, began, used, gone, [{c: list(v) if isinstance(v := getattr(r, c), set) else v for c in carried} for r in kept.rows])

        for frame in frames:
            for column in ("tokens", "vendors", "models"):
                frame[column] = frame[column].map(set)
            for row in frame.itertuples(index=False):
                if (row.site, row.slice) != at:
                    if used is not None:
                        out.append(told())
                    at, kept, used, gone = (row.site, row.slice), _Kept(hours, least, look_back), None, []
                if row.step == 0:
                    kept.rows.append(row)
                    continue
                if row.step == 2 and used is None:
                    began = row.at
                    used = [r.id if began - r.at <= reach else "" for r in kept.rows]
                    used = used[next((k for k, x in enumerate(used) if x), len(used)) :]
                lost = kept.loser(row)
                if lost is not None and row.step == 2:
                    gone.append(lost)
            if out:
                yield pd.DataFrame(out, columns=["site", "slice", "began", "used", "gone", "left"])
                out = []
        if used is not None:
            yield pd.DataFrame([told()], columns=["site", "slice", "began", "used", "gone", "left"])

    def passed(before: DataFrame, own: DataFrame) -> DataFrame:
        """What each slice was run on, drops and leaves. step: 0 what the look-back holds, 1 rows it is guessed from, 2 the slice's own."""
        both = before.unionByName(own.withColumns({"step": F.lit(2), "place": F.lit(0)}))
        dealt = both.repartition(parts, "site", "slice").sortWithinPartitions("site", "slice", "step", "place", "at", "id")
        return written(dealt.mapInPandas(run, f"site string, slice int, began long, used array<string>, gone array<string>, left {state}"))

    last = F.row_number().over(Window.partitionBy("site", "slice").orderBy(F.desc("at"), F.desc("id")))
    ahead = rows.withColumn("n", last).where(F.col("n") <= warm).withColumn("slice", F.col("slice") + 1).withColumns({"step": F.lit(1), "place": F.lit(0)}).drop("n")
    slices = rows.select("site", "slice").distinct()
    done = passed(ahead.join(slices, ["site", "slice"], "left_semi"), rows)
    while True:
        leaves = done.select("site", (F.col("slice") + 1).alias("slice"), F.col("left").alias("held"))
        near = F.transform("held", lambda r: F.when(F.col("began") - r["at"] <= reach, r["id"]).otherwise(""))
        first = F.array_position(F.transform(near, lambda x: x != ""), True)
        due = F.when(first > 0, F.slice(near, first.cast("int"), F.size(near))).otherwise(F.array().cast("array<string>"))
        wrong = written(done.join(leaves, ["site", "slice"]).where(due != F.col("used")).select("site", "slice", "held"))
        if not wrong.limit(1).count():
            break
        held = wrong.select("site", "slice", F.posexplode("held").alias("place", "r")).select("site", "slice", "r.*", "place", F.lit(0).alias("step"))
        again = passed(held, rows.join(wrong.select("site", "slice"), ["site", "slice"], "left_semi"))
        done = written(done.join(wrong.select("site", "slice"), ["site", "slice"], "left_anti").unionByName(again))
    gone = done.select(F.explode("gone").alias("id")).select(F.col("id").cast(kind_of_id)).distinct()
    return items.join(gone, "id", "left_anti")


def creator_items(archive: DataFrame, now: datetime, days: int = 7, related_only: bool = False) -> DataFrame:
    """The creators' items of the last days, scored, without copies and rewrites, hottest first.

    archive: an archive's columns with creator_metrics, which rows without
    count for nothing, and event_time, which must lie within the days.
    """
    at = F.col("event_time")
    own = archive.where(F.col("site_id").isin(CREATOR_SITES) & F.col("creator_metrics").isNotNull() & (at >= F.lit(now) - F.make_dt_interval(days=F.lit(days))) & (at <= F.lit(now)))
    own = own.withColumn("title", repaired(F.coalesce("title", F.lit("")))).withColumn("source", repaired(displayed_source(F.col("site_id"), F.col("source"), host_of(F.coalesce("url", F.lit(""))))))
    scored = with_creator_ranking(with_tier(with_relevance(own)), now)
    kept = scored.where("ai_is_related") if related_only else scored
    left = without_near_duplicates(distinct_items(kept))
    return left.orderBy(F.desc("creator_hot_score"), at.desc_nulls_last(), "id")
