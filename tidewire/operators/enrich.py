"""What other tables add to items and stories: authors, titles in another language, reviews by personas, wiki updates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_cjk, reading_length, snippet, stripped
from ..functions.times import any_date
from ..functions.urls import normalized
from .archive import item_id, without_blocked

#: Days that a review is kept, and how refusals begin.
REVIEW_DAYS = 21
REFUSALS = ["抱歉", "我无法处理", "我无法翻译", "我无法提供", "sorry", "cannot", "i can't", "无法处理", "请提供", "请直接提供"]
REFUSAL_OPENING = r"""^[\s"'“”‘’「」『』(（,，.。:：]+"""


def authored(posts: DataFrame, users: DataFrame, now: datetime) -> DataFrame:
    """Posts (post_id, author_id, text, created_at) with their author's username and name, where users (id, username, name) have them."""
    named = users.where("id is not null").groupBy(F.col("id").cast("string").alias("author_id")).agg(F.max_by(F.struct("username", "name"), "username").alias("user"))
    text = snippet(F.coalesce("text", F.lit("")), 220)
    rows = posts.withColumn("title", text).where((F.col("title") != "") & (stripped(F.coalesce("post_id", F.lit(""))) != "")).join(named, "author_id", "left")
    name = F.coalesce(F.nullif(stripped(F.col("user.username")), F.lit("")), F.lit("i/web"))
    url = F.concat(F.lit("https://x.com/"), name, F.lit("/status/"), F.col("post_id"))
    return rows.select("post_id", name.alias("username"), F.col("user.name").alias("name"), "title", url.alias("url"), F.coalesce(any_date(F.col("created_at"), now), F.lit(now)).alias("published_at"))


def titled(items: DataFrame, others: DataFrame) -> DataFrame:
    """items with title_zh, the last CJK title (by pos) that others (title, url, pos) have under the same normalized URL."""
    known = others.where(has_cjk(F.col("title"))).select(normalized(F.coalesce("url", F.lit(""))).alias("_url"), stripped(F.col("title")).alias("t"), "pos").where("_url <> '' and t <> ''")
    last = known.groupBy("_url").agg(F.max_by("t", "pos").alias("title_zh"))
    return items.withColumn("_url", normalized(F.coalesce("url", F.lit("")))).join(last, "_url", "left").drop("_url")

#: What a persona is told of a story.
CONTEXT_FIELDS = ["story_id", "title", "url", "importance_score", "importance_label", "category", "reasons", "source_count"]


def refused(text: Column) -> Column:
    """Begins as a refusal to translate does."""
    bare = F.regexp_replace(F.lower(text), REFUSAL_OPENING, "")
    return F.exists(F.array(*map(F.lit, REFUSALS)), lambda m: F.startswith(bare, m))


def valid_translation(text: Column, strict: bool = True) -> Column:
    """Has four CJK characters at least and is no refusal; strict: 8 to 36 characters as an editor counts them."""
    plain = stripped(F.coalesce(text, F.lit("")))
    enough = F.regexp_count(plain, F.lit(r"[\x{4e00}-\x{9fff}]")) >= 4
    return enough & ~refused(plain) & (reading_length(plain).between(8, 36) if strict else F.lit(True))


def review_key(story_id: Column, persona: Column, version: Column) -> Column:
    return F.concat_ws("|", story_id, persona, version)


def title_mark(title: Column) -> Column:
    return F.left(F.sha1(F.coalesce(title, F.lit(""))), F.lit(8))


def clamped(score: Column) -> Column:
    """A whole score from 0 to 100, halves to the even; 0 for what is no number."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.bround(score.try_cast("double"), 0), F.lit(0.0)))).cast("int")


def kept_reviews(cache: DataFrame, now: datetime, days: int = REVIEW_DAYS) -> DataFrame:
    """The cache's rows (key, title_mark, scored_at, ..) that aren't too old; undated ones go."""
    return cache.where(F.col("scored_at") >= F.lit(now) - F.make_dt_interval(days=F.lit(days)))


def reviewed(items: DataFrame, personas: list[tuple[str, str]], cache: DataFrame) -> DataFrame:
    """Every item (story_id, title) with each of the personas (name, version; a setting) and what the cache holds for both, if the title is still the same."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("persona"), F.lit(v).alias("version")) for p, v in personas)))
    pairs = items.withColumn("p", each).select("*", "p.persona", "p.version").drop("p").withColumn("key", review_key(F.col("story_id"), F.col("persona"), F.col("version"))).withColumn("mark", title_mark(F.col("title")))
    held = cache.select("key", F.col("title_mark").alias("mark"), "review", clamped(F.col("score")).alias("score"))
    return pairs.join(held, ["key", "mark"], "left")


def top_stories(items: DataFrame, most: int = 3) -> DataFrame:
    """The `most` items of highest persona_score, then importance, with their rank."""
    order = [F.desc("persona_score"), F.desc(F.coalesce("importance", F.lit(0.0))), F.asc("story_id")]
    first = items.where("persona_score is not null").orderBy(*order).limit(most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def wiki_updates(updates: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates (date, title, url) that no block list names, newest first; and one row (latest_date, count_today, count_7d) over them."""
    source = F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit("社区更新 · "), F.col("date"))).otherwise("社区更新")
    rows = updates.withColumn("source", source).withColumn("id", item_id(F.lit("waytoagi"), F.col("source"), F.col("title"), F.col("url")))
    left = without_blocked(without_blocked(rows, blocked).withColumn("source", F.lit("WaytoAGI")), blocked).select(*updates.columns)
    latest = left.agg(F.max("date").alias("latest_date"), F.count("*").alias("count_7d"))
    today = left.groupBy("date").agg(F.count("*").alias("count_today"))
    counts = latest.join(today, F.col("date") == F.col("latest_date"), "left").select("latest_date", F.coalesce("count_today", F.lit(0)).alias("count_today"), "count_7d")
    return left.orderBy(F.desc("date"), F.desc("title")), counts


def frontmatter(texts: DataFrame) -> DataFrame:
    """Files (name, body) that begin with a block of `key: value` lines between dashes, as (name, meta map, body); others go."""
    found = texts.select("name", F.regexp_extract("body", r"(?s)^\s*---[ \t]*\n(.*?)\n---[ \t]*(?:\n(.*))?$", 1).alias("head"), F.regexp_extract("body", r"(?s)^\s*---[ \t]*\n(.*?)\n---[ \t]*(?:\n(.*))?$", 2).alias("rest")).where("head <> ''")
    lines = F.filter(F.transform(F.split("head", "\n"), stripped), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(stripped(F.substring_index(x, ":", 1)).alias("k"), stripped(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    # Of a repeated key the last line counts.
    later = lambda p, k: F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q["k"] == p["k"])
    last = F.map_from_entries(F.filter(pairs, lambda p, k: (p["k"] != "") & ~later(p, k)))
    return found.select("name", last.alias("meta"), stripped(F.col("rest")).alias("body"))


def summary_missing(summary: Column, title: Column) -> Column:
    """The summary is empty or but the title again."""
    s = stripped(F.coalesce(summary, F.lit("")))
    return (s == "") | (s == stripped(F.coalesce(title, F.lit(""))))


def item_context(stories: DataFrame) -> DataFrame:
    """(story_id, context as JSON) of what a persona is told of a story: the fields that are there, and the names of its sources (array of structs) that have one."""
    fields = [F.col(c) for c in CONTEXT_FIELDS if c in stories.columns]
    if "sources" in stories.columns:
        fields.append(F.transform(F.filter("sources", lambda s: F.coalesce(s["source"], F.lit("")) != ""), lambda s: F.struct(s["source"].alias("source"))).alias("sources"))
    return stories.select("story_id", F.to_json(F.struct(*fields)).alias("context"))


def fallback_scores(items: DataFrame, now: datetime, persona: str | None = None) -> DataFrame:
    """items with a persona's score by their importance alone, where no persona can be asked; no review."""
    left = items.drop("persona_review", "persona_id", "persona_score", "persona_meta")
    return left.withColumns({"persona_id": F.lit(persona or "pragmatic"), "persona_score": clamped(F.coalesce(F.col("importance_score").cast("string"), F.lit("0"))), "persona_meta": F.struct(F.lit("rules_fallback").alias("mode"), F.lit(now).alias("scored_at"))})
