"""What a candidate source shares with the items already there."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap_entities, overlap_title, stripped, title_tokens
from ..functions.urls import normalized
from .graph import written
from .sets import alike_sets
from .tiles import tiled
from .titles import Title, near_enough, pairs_within, sets_within

#: Scores from which titles are the same, or may be, and the days that may lie between the latter.
SAME, MAYBE, DAYS = 0.88, 0.62, 2
#: Scores are rounded to three digits, so these count as SAME and MAYBE.
SAME_ROUNDED, MAYBE_ROUNDED = SAME - 0.0005 - 1e-9, MAYBE - 0.0005 - 1e-9


def classified(candidates: DataFrame, baseline: DataFrame, least: float = 0.88) -> DataFrame:
    """(id, match, best_id, similarity): the best match of each candidate (id, site_id, title, url) in the baseline of other sites.

    url_exact before title_exact before title_similarity (Jaccard of title
    tokens). Both exact stages are equi-joins on the distinct keys of the
    baseline; only what they leave goes on to tokens, as sets that meet at
    their rarest ones.
    """
    base = written(baseline.select(F.col("id").alias("base_id"), F.col("site_id").alias("base_site"), normalized(F.coalesce("url", F.lit(""))).alias("url_key"), F.lower("title").alias("title_key"), title_tokens(F.coalesce("title", F.lit(""))).alias("base_tokens")))
    mine = written(candidates.select("id", "site_id", normalized(F.coalesce("url", F.lit(""))).alias("url_key"), F.lower("title").alias("title_key"), title_tokens(F.coalesce("title", F.lit(""))).alias("tokens")))

    def exact(left: DataFrame, key: str, name: str) -> DataFrame:
        # The smallest id of each key, and the smallest of another site: enough for any candidate.
        ids = base.where(F.col(key) != "").groupBy(key, "base_site").agg(F.min("base_id").alias("i"))
        first = ids.groupBy(key).agg(F.min_by(F.struct("i", "base_site"), "i").alias("first"))
        second = ids.join(first, key).where("base_site <> first.base_site").groupBy(key).agg(F.min("i").alias("second"))
        table = first.join(second, key, "left")
        best = F.when(F.col("first.base_site") != F.coalesce(F.col("site_id"), F.lit("")), F.col("first.i")).otherwise(F.col("second"))
        return left.join(table, key).select("id", F.lit(name).alias("match"), best.alias("best_id")).where("best_id is not null")

    urls = written(exact(mine, "url_key", "url_exact"))
    rest = mine.join(urls, "id", "left_anti")
    titles = written(exact(rest, "title_key", "title_exact"))
    rest = written(rest.join(titles, "id", "left_anti"))
    sets = lambda df, c: df.select(F.array_sort(c).alias("words")).distinct()
    alike_ = alike_sets(sets(rest, "tokens"), sets(base, "base_tokens"), least)
    # Of each set the smallest id of each site goes on.
    ids = base.groupBy(F.array_sort("base_tokens").alias("other"), "base_site").agg(F.min("base_id").alias("base_id"))
    shared = F.size(F.array_intersect("words", "other")) / F.size(F.array_union("words", "other"))
    near = alike_.withColumn("similarity", shared).join(ids, "other").join(rest, F.col("words") == F.array_sort("tokens")).where("base_site is distinct from site_id")
    best = near.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "base_id")).alias("b"))
    similar = best.select("id", F.lit("title_similarity").alias("match"), F.col("b.base_id").alias("best_id"), F.round(-F.col("b.s"), 3).alias("similarity"))
    sure = urls.union(titles).withColumn("similarity", F.lit(1.0))
    return sure.unionByName(similar)


def recommendation(items: Column, rate: Column) -> Column:
    """What to do with a source by its items and the share of them that others have."""
    return F.when(items < 5, "watchlist").when(rate >= 0.65, "skip").when(rate >= 0.35, "watchlist").otherwise("accept")


def alike(a: str, b: str) -> float:
    """Of two normal titles: the best of matching blocks, shared words and matching blocks of sorted words."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    return round(max(SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y), SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio()), 3)


def _sorted_words(title: str) -> str:
    return " ".join(sorted(set(title.split())))


def _title_pairs(mine: DataFrame, base: DataFrame) -> DataFrame:
    """(normal, base_normal, score) of all distinct titles that may make a match.

    What scores SAME has alike blocks in the titles or in their sorted words,
    and so alike lengths (blocks of lengths and their neighbours, screened by
    bounds), or alike sets of words. What scores less counts only if both name
    a known thing within some days: blocks of such a name and a stretch of
    days (and one for unknown times), screened by the bounds at MAYBE.
    """
    # Lengths of a pair of the ratio r differ by a factor of (2 - r) / r at most: they lie in one band or in neighbouring ones.
    band = lambda c: F.floor(F.log(F.length(c).cast("double")) / F.log(F.lit((2 - SAME_ROUNDED) / SAME_ROUNDED)) + 1e-9).cast("long")
    in_order = F.array_join(F.array_sort(F.array_distinct(F.split("normal", " "))), " ")
    days = F.floor(F.unix_micros("at") / (DAYS * 86_400_000_000)).cast("long")
    left, right = mine.select("normal", "at"), base.select(F.col("base_normal").alias("normal"), F.col("base_at").alias("at"))

    def marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["marks"] = [Title(t).marks() for t in frame["normal"]]
            frame["turned"] = [Title(_sorted_words(t)).marks() for t in frame["normal"]]
            yield frame

    def blocks(df: DataFrame, around: bool) -> DataFrame:
        near = (lambda c: F.explode(F.array(c - 1, c, c + 1))) if around else (lambda c: F.explode(F.array(c)))
        block = lambda kind, *parts: F.concat_ws(":", F.lit(str(kind)), *(p.cast("string") for p in parts)).alias("block")
        # What the bounds need is worked out once for each title; few have a name, and these get it where they meet.
        titles = written(df.where("normal <> ''").select("normal").distinct().mapInPandas(marked, "normal string, marks binary, turned binary"))
        by_size = [titles.select("normal", m, near(band(c)).alias("k")).select(block(kind, F.col("k")), F.lit(kind).alias("kind"), "normal", F.col(m).alias("marks")) for kind, c, m in ((0, F.col("normal"), "marks"), (1, in_order, "turned"))]
        named = df.where("normal <> ''").select("normal", days.alias("d")).distinct().select("normal", "d", F.explode(overlap_entities(F.col("normal"))).alias("e"))
        dated = named.where("d is not null").select("normal", "e", near(F.col("d")).alias("k")).select(block(2, F.col("e"), F.col("k")), F.lit(2).alias("kind"), "normal")
        # Unknown times meet all others: those of the one side in a block for all of the other.
        mark = lambda m: block(2, F.col("e"), F.lit(m))
        any_time = named.select(mark("left unknown" if not around else "right unknown"), F.lit(2).alias("kind"), "normal")
        unknown = named.where("d is null").select(mark("right unknown" if not around else "left unknown"), F.lit(2).alias("kind"), "normal")
        return by_size[0].union(by_size[1]).union(dated.union(any_time).union(unknown).distinct().withColumn("marks", F.lit(None).cast("binary")))

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        kind, a, b = int(one["kind"].iloc[0]), one["normal"].tolist(), two["normal"].tolist()
        pairs = set()
        for turned in [False] if kind == 0 else [True] if kind == 1 else [False, True]:
            x, y = ([Title(_sorted_words(t) if turned else t, m) for t, m in zip(ts, f["marks"])] for ts, f in ((a, one), (b, two)))
            least = MAYBE_ROUNDED if kind == 2 else SAME_ROUNDED
            pairs |= {(a[i], b[j]) for i, j in near_enough(x, y, pairs_within(x, y, least), least)}
        if kind == 2:  # what blocks don't tell, shared words may
            pairs |= {(a[i], b[j]) for i, j in sets_within([set(t.split()) for t in a], [set(t.split()) for t in b], MAYBE_ROUNDED)}
        return pd.DataFrame(sorted(pairs), columns=["normal", "base_normal"], dtype="str")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["score"] = [alike(x, y) for x, y in zip(frame["normal"], frame["base_normal"])]
            yield frame[frame["score"] >= MAYBE]

    met = tiled(blocks(left, True), blocks(right, False), compare, "normal string, base_normal string")
    # Words of a title are told apart in its text, which is why texts go with their sets.
    sets = lambda df: df.where("normal <> ''").select(F.array_sort(F.array_distinct(F.split("normal", " "))).alias("words"), "normal").distinct()
    ours, theirs = sets(left), sets(right).select(F.col("words").alias("other"), F.col("normal").alias("base_normal"))
    shared = alike_sets(ours.select("words").distinct(), theirs.select(F.col("other").alias("words")).distinct(), SAME_ROUNDED)
    met = met.union(shared.join(ours, "words").join(theirs, "other").select("normal", "base_normal")).distinct()
    none = mine.sparkSession.createDataFrame([("", "", 0.0)], "normal string, base_normal string, score double")
    return met.mapInPandas(score, "normal string, base_normal string, score double").union(none)


def compared(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, match, best_id, score, hard) of the candidates (id, site_id, title, url, event_time) that the baseline's other sites tell too.

    A candidate whose URL the baseline has is compared with those rows alone
    (url_exact); any other with titles: title_exact, title_similarity, or
    entity_time_possible if a title that scores less names the same thing
    within two days (unknown times pass). The hard match of the highest score
    counts, else the possible one; ties go to the smallest id.
    """
    mine = candidates.select("id", F.coalesce("site_id", F.lit("")).alias("site_id"), normalized(F.coalesce("url", F.lit(""))).alias("url"), F.lower(stripped(F.coalesce("title", F.lit("")))).alias("low"), overlap_title(F.col("title")).alias("normal"), F.col("event_time").alias("at"))
    base = baseline.select(*(F.col(c).alias(f"base_{c}") for c in ("id",)), F.coalesce("site_id", F.lit("")).alias("base_site"), normalized(F.coalesce("url", F.lit(""))).alias("base_url"), F.lower(stripped(F.coalesce("title", F.lit("")))).alias("base_low"), overlap_title(F.col("title")).alias("base_normal"), F.col("event_time").alias("base_at"))
    mine, base = written(mine), written(base)
    ids = base.where("base_url <> ''").groupBy("base_url", "base_site").agg(F.min("base_id").alias("i"))
    # Of each URL the smallest id of each site goes on, so a hot URL makes a row a site.
    urls = mine.where("url <> ''").join(ids, (F.col("url") == F.col("base_url")) & (F.col("site_id") != F.col("base_site"))).groupBy("id").agg(F.min("i").alias("best_id"))
    sure = written(urls.select("id", F.lit("url_exact").alias("match"), "best_id", F.lit(1.0).alias("score"), F.lit(True).alias("hard")))
    rest = written(mine.join(sure, "id", "left_anti"))
    pairs = written(_title_pairs(rest, base))
    exact = (F.col("normal") == F.col("base_normal")) & (F.col("low") == F.col("base_low"))
    # Of each title the smallest id of each site goes on, so a hot title makes a row a site.
    ids = base.groupBy("base_normal", "base_low", "base_site").agg(F.min("base_id").alias("base_id"))
    same = rest.join(pairs.where((F.col("score") >= SAME) | (F.col("normal") == "")), "normal").join(ids, "base_normal").where("site_id <> base_site")
    same = same.withColumn("match", F.when(exact, "title_exact").when(F.col("score") >= SAME, "title_similarity"))
    named = F.size(F.array_intersect(overlap_entities(F.col("normal")), overlap_entities(F.col("base_normal")))) > 0
    near = F.coalesce(F.abs(F.unix_micros("at") - F.unix_micros("base_at")) <= DAYS * 86_400_000_000, F.lit(True))
    maybe = rest.join(pairs.where((F.col("score") < SAME) & (F.col("normal") != "") & named), "normal").join(base, "base_normal").where("site_id <> base_site").where(near).withColumn("match", F.lit("entity_time_possible"))
    columns = ["id", "base_id", "score", "match"]
    found = same.select(*columns).union(maybe.select(*columns)).where("match is not null").withColumn("hard", F.col("match") != "entity_time_possible")
    best = found.groupBy("id").agg(F.min(F.struct((~F.col("hard")).alias("soft"), (-F.col("score")).alias("s"), F.col("base_id").alias("best_id"), "match")).alias("b"))
    return sure.union(best.select("id", "b.match", "b.best_id", -F.col("b.s"), ~F.col("b.soft")))


def report(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """(site_id, items, duplicates, possible, unique, rate, decision): what a source brings, by its matches."""
    rows = candidates.select("id", "site_id").join(matches.select("id", "hard"), "id", "left")
    out = rows.groupBy("site_id").agg(F.count("*").alias("items"), F.count_if("hard").alias("duplicates"), F.count_if(~F.col("hard")).alias("possible"))
    rate = F.round(F.col("duplicates") / F.col("items"), 3)
    return out.withColumns({"unique": F.col("items") - F.col("duplicates") - F.col("possible"), "rate": rate, "decision": recommendation(F.col("items"), rate)})


def top_sources(matches: DataFrame, baseline: DataFrame, most: int = 10) -> DataFrame:
    """(site_id, n): the baseline's sites that told most of the hard matches."""
    own = baseline.select(F.col("id").alias("best_id"), "site_id").distinct()
    return matches.where("hard").join(own, "best_id").groupBy("site_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site_id").limit(most)
