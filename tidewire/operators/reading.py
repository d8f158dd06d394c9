"""The read side: filters, lists, sections, events, groups and boards over items and stories.

Items come with id, site_id, site_name, source, title, url, published_at,
first_seen_at, ai_score, ai_label, ai_signals, source_tier, source_tier_rank,
aihot_score and, where known, creator_hot_score. `now` is the snapshot's time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reading as r
from ..functions.scores import unsafe
from ..functions.times import hours_between

PAGE, BOARD, CLUSTERS, HEADLINES = 60, 20, 8, 3
#: What is hot. Hours, and least importance in percent alone and with a trusted source.
HOT_HOURS, HOT_DECAY, HOT_SCORE, HOT_TRUSTED = 24, 12, 82, 76


def _column(items: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in items.columns else F.lit(None).cast(kind)


def safe(items: DataFrame, texts: tuple[str, ...] = ("title", "source", "site_name")) -> DataFrame:
    """Rows whose texts say nothing unsafe."""
    return items.where(~unsafe(F.concat_ws(" ", *texts)))


def viewed(items: DataFrame, now: datetime) -> DataFrame:
    """Adds at, group, section, source_type, signal, curated, author, author_name, score_pct, priority, high, grade and event."""
    site, source, name = F.col("site_id"), F.col("source"), F.col("site_name")
    hot = r.capped_percent(_column(items, "creator_hot_score", "double"))
    hay = r.haystack(F.col("title"), source, name, site, F.col("ai_label"), signals=F.col("ai_signals"))
    out = items.withColumns({
        "at": r.timeline(F.col("published_at"), F.col("first_seen_at"), now), "group": r.source_group(site, source, name), "hay": hay, "score_pct": r.percent(F.col("ai_score")),
        "signal": r.source_signal(name, source), "source_type": r.source_type(site, F.col("source_tier")), "curated": r.curated(site, F.col("source_tier")), "author": r.author(site, source),
        "author_name": r.author_display(site, source), "event": r.event_key(F.col("title")), "_hot": hot,
    })
    parts = r.priority_parts(site, F.col("source_tier_rank"), F.col("ai_score"), F.col("aihot_score"), F.col("at"), F.size("ai_signals"), now)
    creator = (F.col("group") == "creator") & (F.col("_hot") > 0)
    out = out.withColumn("section", r.section(F.col("group"), F.col("ai_label"), F.col("hay"))).withColumn("priority", F.when(creator, F.col("_hot")).otherwise(r.priority(parts)))
    shown = F.when(creator, F.col("_hot")).otherwise(F.col("score_pct"))
    return out.withColumns({"high": r.high_priority(shown, F.col("priority"), site), "grade": r.grade(F.col("priority"))}).drop("_hot")


def chosen(items: DataFrame, section: str | None = None, site: str | None = None, author: str | None = None, source_type: str | None = None, query: str = "", level: str | None = None) -> DataFrame:
    """The viewed items that satisfy every given filter; level is high, curated or multi (its event has two source signals among what is left)."""
    texts = F.lower(F.concat_ws(" ", "title", "site_name", "source"))
    tests = [(section if section != "all" else None, F.col("section") == section), (site, F.col("site_id") == site), (author, F.col("author") == author), (source_type, F.col("source_type") == source_type)]
    for given, test in [*tests, (query.strip(), F.contains(texts, F.lit(query.strip().lower())))]:
        items = items.where(test) if given else items
    if level == "multi":
        return items.join(confirmed_events(items), "event", "left_semi")
    return items.where(F.col(level)) if level in ("high", "curated") else items


def confirmed_events(items: DataFrame) -> DataFrame:
    """(event) of events that two source signals or more have; least and greatest tell, so no set is gathered."""
    return items.groupBy("event").agg(F.min("signal").alias("a"), F.max("signal").alias("b")).where("a <> b").select("event")


def listed(items: DataFrame, order: str = "priority") -> tuple[DataFrame, list[Column]]:
    """The viewed items, and how they are ordered: latest, ai, source (largest source first) or priority; ties go by id."""
    at, best = F.col("at").desc_nulls_last(), F.desc("priority")
    if order == "latest":
        return items, [at, best, F.asc("id")]
    if order == "ai":
        return items, [F.desc("score_pct"), best, at, F.asc("id")]
    if order == "source":
        keyed = items.withColumn("source_key", F.concat_ws(" ", "signal", F.coalesce("site_name", "site_id"), "source"))
        counts = keyed.groupBy("source_key").agg(F.count("*").alias("source_items"))
        return keyed.join(counts, "source_key"), [F.desc("source_items"), F.asc("source_key"), best, at, F.asc("id")]
    return items, [best, at, F.asc("id")]


def page(items: DataFrame, order: str = "priority", size: int = PAGE) -> DataFrame:
    """The first `size` items of an order, with their place from 1 on. Only these are ranked."""
    rows, keys = listed(items, order)
    first = rows.orderBy(*keys).limit(size)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*keys)))


def days(items: DataFrame, at: str = "at", zone: str = "Asia/Shanghai") -> DataFrame:
    """(day, n): items of each local day; unknown times have a null day."""
    return items.groupBy(F.to_date(F.from_utc_timestamp(F.col(at), zone)).alias("day")).agg(F.count("*").alias("n"))


def section_view(items: DataFrame) -> DataFrame:
    """(section, n, high, sources) of viewed items by section, and of all under "all"."""
    one = items.withColumn("section", F.explode(F.array_distinct(F.array(F.col("section"), F.lit("all")))))
    return one.groupBy("section").agg(F.count("*").alias("n"), F.count_if("high").alias("high"), F.count_distinct(F.coalesce("source", "site_name", "site_id")).alias("sources"))


def authors(items: DataFrame) -> DataFrame:
    """(author, name, n): each author once; the longest name shown for them, which says most."""
    known = items.where("author is not null")
    return known.groupBy("author").agg(F.max_by("author_name", F.struct(F.length("author_name"), "author_name")).alias("name"), F.count("*").alias("n"))


def event_clusters(items: DataFrame) -> DataFrame:
    """One row for each event of scored items: primary item, source signals, members and score.

    The primary has the best source signal, then score, then time, then the
    smallest id. The score is the best one, with bonuses for more signals and
    for trusted ones. All is one combinable aggregate: there are few signals.
    """
    rows = items.where("score_pct > 0")
    best = F.struct(-r.source_priority(F.col("signal")), -F.col("score_pct"), F.coalesce(-F.unix_micros("at"), F.lit(0)), F.col("id"))
    out = rows.groupBy("event").agg(
        F.min_by(F.struct("id", "site_id", "title", "priority", "at"), best).alias("main"), F.array_sort(F.collect_set("signal")).alias("signals"), F.count("*").alias("members"), F.max("score_pct").alias("top"),
    )
    has = lambda *names: F.arrays_overlap("signals", F.array(*map(F.lit, names)))
    bonus = F.least(F.lit(12), (F.size("signals") - 1) * 6) + F.when(has("AI HOT精选"), 8).when(has("HN热议", "GitHub趋势"), 6).when(has("官方更新"), 5).otherwise(0)
    return out.select("event", "main", "signals", "members", F.size("signals").alias("sources"), F.least(F.lit(100), F.col("top") + bonus).alias("score"))


def picked_events(clusters: DataFrame, most: int = CLUSTERS) -> DataFrame:
    """The `most` leading events, after the best one of each of three channels; place from 1 on."""
    order = [F.desc("sources"), F.desc("score"), F.col("main.at").desc_nulls_last(), F.asc("main.id")]
    seeds = [clusters.where(F.array_contains("signals", s)).orderBy(*order).limit(1).withColumn("seed", F.lit(k)) for k, s in enumerate(("AI HOT精选", "HN热议", "GitHub趋势"))]
    rows = clusters.orderBy(*order).limit(most).withColumn("seed", F.lit(len(seeds)))
    for s in seeds:
        rows = rows.union(s)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("event").orderBy("seed"))).where("n = 1")
    return first.withColumn("place", F.row_number().over(Window.orderBy("seed", *order))).where(F.col("place") <= most).drop("n", "seed")


def headlines(clusters: DataFrame, most: int = HEADLINES) -> DataFrame:
    """The events of highest priority, lifted by their sources and members."""
    lifted = F.col("main.priority") + F.least(F.lit(18), (F.col("sources") - 1) * 9) + F.least(F.lit(8), (F.col("members") - 1) * 4)
    return clusters.withColumn("headline", F.least(F.lit(100), lifted)).orderBy(F.desc("headline"), F.col("main.at").desc_nulls_last(), F.asc("main.id")).limit(most)


def source_groups(items: DataFrame) -> DataFrame:
    """(site_id, source, raw, shown, value): per source all items, those left when equal titles count once, and the mean priority of its three best."""
    plain = r.event_text(F.col("title"))
    key = F.when(plain != "", plain).otherwise(F.coalesce(F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^?#]*", 0), F.lit("")), F.col("id")))
    one = items.groupBy("site_id", F.coalesce("source", F.lit("")).alias("source"), key.alias("key")).agg(F.max("priority").alias("priority"), F.count("*").alias("raw"))
    counts = one.groupBy("site_id", "source").agg(F.sum("raw").alias("raw"), F.count("*").alias("shown"))
    best = one.withColumn("n", F.row_number().over(Window.partitionBy("site_id", "source").orderBy(F.desc("priority"), "key"))).where("n <= 3")
    return counts.join(best.groupBy("site_id", "source").agg(r.half_up(F.avg("priority")).alias("value")), ["site_id", "source"])


def site_groups(sources: DataFrame) -> DataFrame:
    """(site_id, sources, raw, shown, place): sites by items shown."""
    out = sources.groupBy("site_id").agg(F.count("*").alias("sources"), F.sum("raw").alias("raw"), F.sum("shown").alias("shown"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("shown"), "site_id")))  # one row a site


def site_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("site_id").agg(F.min("site_name").alias("site_name"), F.count("*").alias("n")).orderBy(F.desc("n"), "site_name")


def matching_stories(stories: DataFrame, members: DataFrame, query: str = "", site: str | None = None, author: str | None = None) -> DataFrame:
    """Stories of which some member (story_id, site_id, source, site_name, title) is of the site and author, and some, or the story, has the words."""
    if site or author:
        fit = F.lit(True)
        if site:
            fit = fit & (F.col("site_id") == site)
        if author:
            fit = fit & (r.author(F.col("site_id"), F.col("source")) == author)
        stories = stories.join(members.where(fit).select("story_id"), "story_id", "left_semi")
    if query.strip():
        texts = members.select("story_id", F.concat_ws(" ", "title", "source", "site_name").alias("t")).union(stories.select("story_id", F.col("title").alias("t")))
        stories = stories.join(texts.where(F.contains(F.lower("t"), F.lit(query.strip().lower()))).select("story_id"), "story_id", "left_semi")
    return stories


def safe_stories(stories: DataFrame, members: DataFrame) -> DataFrame:
    """Stories of which neither the title nor any member is unsafe."""
    bad = members.where(unsafe(F.concat_ws(" ", "title", "source", "site_name"))).select("story_id")
    return stories.where(~unsafe(F.coalesce("title", F.lit("")))).join(bad, "story_id", "left_anti")


def curated_stories(stories: DataFrame, members: DataFrame, brief: DataFrame) -> DataFrame:
    """(story_id) of stories that share an identity key with a story of the brief (story_id); keys join as rows."""
    own = stories.select("story_id", F.explode(r.identity_keys(F.col("story_id"), F.col("title"), F.col("url"))).alias("key"))
    keys = own.union(members.select("story_id", F.explode(r.identity_keys(F.col("id"), F.col("title"), F.col("url"))).alias("key"))).distinct()
    chosen_keys = keys.join(brief.select("story_id"), "story_id", "left_semi").select("key").distinct()
    return keys.join(chosen_keys, "key", "left_semi").select("story_id").distinct()


def hot_board(stories: DataFrame, members: DataFrame, now: datetime, most: int = BOARD) -> DataFrame:
    """The stories of the last day that two items, a high score or a trusted source vouch for, hottest first.

    stories: story_id, score, item_count, latest_at, earliest_at. hot_score is
    in percent, 1 at least.
    """
    trusted = members.where(r.curated(F.col("site_id"), F.col("source_tier"))).select("story_id").distinct().withColumn("trusted", F.lit(True))
    age = F.greatest(F.lit(0.0), hours_between(F.lit(now), F.coalesce("latest_at", "earliest_at")))
    rows = stories.join(trusted, "story_id", "left").withColumns({"age": age, "pct": r.percent(F.col("score"))})
    fit = (F.col("item_count") >= 2) | (F.col("pct") >= HOT_SCORE) | (F.coalesce("trusted", F.lit(False)) & (F.col("pct") >= HOT_TRUSTED))
    heat = F.least(F.lit(1.0), F.col("pct") / 100.0) * F.lit(0.45) + F.least(F.lit(1.0), (F.col("item_count") - 1) / 3.0) * F.lit(0.35) + F.exp(-F.col("age") / HOT_DECAY) * F.lit(0.2)
    hot = rows.where(fit & (F.col("age") <= HOT_HOURS)).withColumn("hot_score", F.greatest(F.lit(1), F.least(F.lit(100), r.half_up(heat * 100))))
    return hot.orderBy(F.desc("hot_score"), F.desc("pct"), F.desc("item_count"), F.col("latest_at").desc_nulls_last(), "story_id").limit(most).select("story_id", "hot_score", "pct", "item_count")


def spread_hotness(copies: Column, age: Column) -> Column:
    """The older page's measure: sources beyond the first, halved and halved again as hours go by."""
    return F.when(copies >= 2, (copies - 1) * F.exp(-age / HOT_DECAY)).otherwise(0.0)


def duration_label(earliest: Column, latest: Column) -> Column:
    """How long a story has been growing, in words; empty for one time."""
    minutes = r.half_up(F.abs(F.unix_micros(latest) - F.unix_micros(earliest)) / 6e7)
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    long = F.when(minutes % 60 > 0, F.concat(F.lit("发酵 "), hours, F.lit("小时"), rest, F.lit("分"))).otherwise(F.concat(F.lit("发酵 "), hours, F.lit("小时")))
    label = F.when(minutes < 20, "短时集中").when(minutes < 60, F.concat(F.lit("发酵 "), minutes.cast("string"), F.lit(" 分钟"))).otherwise(long)
    return F.when(earliest.isNull() | latest.isNull() | (earliest == latest), "").otherwise(label)


def report_times(members: DataFrame) -> DataFrame:
    """(story_id, at) of each report once: reports are told apart by URL, else id."""
    key = F.coalesce(F.nullif("url", F.lit("")), F.col("id"))
    return members.groupBy("story_id", key.alias("key")).agg(F.min("at").alias("at")).where("at is not null").select("story_id", "at")


def leading(items: DataFrame, most: int, label: str | None = None, keyword: str | None = None) -> DataFrame:
    """The first `most` related items by tier rank and score, of one label or with one word in title or signals."""
    rows = items.where("ai_is_related")
    if label:
        rows = rows.where(F.col("ai_label") == label)
    if keyword:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", F.col("title"), F.col("ai_signals"))), F.lit(keyword.lower())))
    return rows.orderBy("source_tier_rank", F.desc("ai_score"), "id").limit(most)


def leading_stories(stories: DataFrame, generated: datetime, now: datetime, most: int = 15, stale_hours: int = 48) -> DataFrame:
    """The most important stories of a snapshot that isn't stale, else none."""
    fresh = (now - generated).total_seconds() <= stale_hours * 3600
    return stories.where(F.lit(fresh)).orderBy(F.desc("score"), "story_id").limit(most)


def story_rows(stories: DataFrame, members: DataFrame) -> DataFrame:
    """(story_id, section, signals, others): the section of each story's primary item, its distinct source signals, and its members under another URL than the primary's, or all if there is none.

    stories: story_id, primary_id, url; members: viewed items with story_id.
    """
    other = F.count_if(F.col("m.url") != F.col("s.url"))
    rows = members.alias("m").join(stories.alias("s"), F.col("m.story_id") == F.col("s.story_id"))
    return rows.groupBy(F.col("s.story_id").alias("story_id")).agg(
        F.max(F.when(F.col("m.id") == F.col("s.primary_id"), F.col("m.section"))).alias("section"), F.array_sort(F.collect_set("m.signal")).alias("signals"), F.when(other > 0, other).otherwise(F.count("*")).alias("others"),
    )


def sections_of() -> Column:
    """All sections of a viewed item (with hay)."""
    content = r.haystack(F.col("title"), F.col("source"), F.col("site_name"), F.col("site_id"), signals=F.col("ai_signals"))
    return r.all_sections(F.col("site_id"), F.col("source"), F.col("site_name"), F.col("ai_label"), F.col("hay"), content)


def labelled(items: DataFrame, now: datetime, active: str = "hot") -> DataFrame:
    """Viewed items with sections, tags, impacts, day and weekday, as the list of the `active` section shows them.

    Only events of several items are joined back, so the join's small side holds repeated titles alone.
    """
    several = items.groupBy("event").agg(F.count("*").alias("_n")).where("_n > 1").select("event", F.lit(True).alias("_confirmed"))
    rows = items.join(several, "event", "left").withColumn("sections", sections_of())
    marks = r.tags(F.col("sections"), F.col("site_id"), F.coalesce("_confirmed", F.lit(False)), active)
    return rows.withColumns({"tags": marks, "impacts": r.impacts(F.col("sections")), "day": r.day_label(F.col("at"), now), "weekday": r.weekday(F.col("at"))}).drop("_confirmed")


def by_section(items: DataFrame) -> DataFrame:
    """(section, id, url, source, high): viewed items (with hay) once for each of their sections, and all under "hot": what counts, lists and exclusions are read from."""
    return items.select(F.explode(F.concat(F.array(F.lit("hot")), sections_of())).alias("section"), "id", "url", F.coalesce("source", "site_name", "site_id").alias("source"), "high")


def stories_within(stories: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Stories of which a member (story_id, id, url) is among the items by its URL or its id."""
    hit = members.where("url <> ''").join(items.select("url").distinct(), "url", "left_semi").select("story_id")
    hit = hit.union(members.join(items.select("id").distinct(), "id", "left_semi").select("story_id"))
    return stories.join(hit.distinct(), "story_id", "left_semi")


def section_stories(inverted: DataFrame, members: DataFrame) -> DataFrame:
    """(section, items, high, sources, stories): counts of each section, and of the stories that have a member in it."""
    of_items = inverted.groupBy("section").agg(F.count("*").alias("items"), F.count_if("high").alias("high"), F.count_distinct("source").alias("sources"))
    by_url = members.where("url <> ''").select("story_id", "url").distinct().join(inverted.where("url <> ''").select("section", "url").distinct(), "url").select("section", "story_id")
    both = by_url.union(members.select("story_id", "id").join(inverted.select("section", "id"), "id").select("section", "story_id"))
    return of_items.join(both.distinct().groupBy("section").agg(F.count("*").alias("stories")), "section", "left").withColumn("stories", F.coalesce("stories", F.lit(0)))


def story_keys(stories: DataFrame, members: DataFrame) -> DataFrame:
    """(story_id, key): the identity keys of stories (story_id, title, url) and of their members (story_id, id, title, url)."""
    own = stories.select("story_id", F.explode(r.identity_keys(F.col("story_id"), F.col("title"), F.col("url"))).alias("key"))
    return own.union(members.select("story_id", F.explode(r.identity_keys(F.col("id"), F.col("title"), F.col("url"))).alias("key"))).distinct()


def item_keys(items: DataFrame) -> DataFrame:
    """(key) of the items (id, title, url) that headlines are made of."""
    return items.select(F.explode(r.identity_keys(F.col("id"), F.col("title"), F.col("url"))).alias("key")).distinct()


def unshown_stories(stories: DataFrame, members: DataFrame, shown: DataFrame, order: str) -> DataFrame:
    """Stories that are under no key (key) of what is shown already, each stable key (id, else URL, else title) once, the first by `order`; those without one all stay."""
    stable = F.coalesce(*(F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in ("story_id", "url", "title")))
    keyed = stories.withColumn("_k", stable)
    once = keyed.where("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*stories.columns), order).alias("row")).select("row.*").union(keyed.where("_k is null").drop("_k"))
    known = story_keys(stories, members).join(shown.select("key"), "key", "left_semi").select("story_id").distinct()
    return once.join(known, "story_id", "left_anti")
