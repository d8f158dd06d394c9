"""Landed payloads of each kind of source as raw items: one function a kind, from a DataFrame of bodies to rows.

Bodies come in columns, so a payload is parsed where it lies and nothing is
gathered. All give site_id, site_name, source, title, url, published_at and
what else a kind tells. Bodies that can't be read give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import allowed_entry, cut, generic_title, keyword_score, repaired, snippet, squeezed, stripped
from ..functions.times import any_date, credible, epoch_or_date, note_id_time
from ..functions.urls import normalized
from ..functions.vocabulary import FEED_REPLACEMENTS, FEED_SKIP_EXACT, FEED_SKIP_PREFIXES

#: Ages in days, least scores and counts.
OFFICIAL_DAYS, CURATED_DAYS, CURATED_ENTRIES = 45, 30, 8
DISCUSSION_SCORE, DISCUSSION_COMMENTS, DISCUSSION_POINTS = 0.38, 2, 10
SELECTED_SCORE = 60


def _first(*texts: Column) -> Column:
    return F.coalesce(*(F.nullif(stripped(t), F.lit("")) for t in texts), F.lit(""))


def _item(site_id: str, site_name: str, source, title: Column, url: Column, at: Column) -> list[Column]:
    source = F.lit(source) if isinstance(source, str) else source
    return [F.lit(site_id).alias("site_id"), F.lit(site_name).alias("site_name"), source.alias("source"), title.alias("title"), url.alias("url"), at.alias("published_at")]


def _young(rows: DataFrame, now: datetime, days: int) -> DataFrame:
    return rows.where(F.col("published_at") >= F.lit(now) - F.make_dt_interval(days=F.lit(days)))


def _text_of(html: Column) -> Column:
    return squeezed(F.regexp_replace(html, r"(?s)<[^>]+>", " "))


def _each(rows: DataFrame, html: Column, pattern: str, groups: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row (keep.., g1, g2, ..) for each match of the pattern."""
    found = F.arrays_zip(*(F.regexp_extract_all(html, F.lit(pattern), k + 1).alias(f"g{k + 1}") for k in range(groups)))
    return rows.select(*keep, F.posexplode(found).alias("pos", "m")).select(*keep, "pos", *(F.col(f"m.g{k + 1}").alias(f"g{k + 1}") for k in range(groups)))


def discussions(payloads: DataFrame, now: datetime) -> DataFrame:
    """Hits of searches (query, pos, body as JSON): of each story the first hit, if it is about the field and talked about.

    The first hit decides alone: one that fails takes later hits of its story with it.
    """
    schema = "hits array<struct<objectID:string,title:string,story_title:string,num_comments:string,points:string,url:string,created_at:string,created_at_i:string>>"
    hits = payloads.select("query", "pos", F.posexplode(F.from_json("body", schema)["hits"]).alias("at", "h")).where("trim(h.objectID) <> ''")
    first = hits.groupBy(stripped(F.col("h.objectID")).alias("hn_id")).agg(F.min_by(F.struct("query", "h"), F.struct("pos", "at")).alias("x"))
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("hn_id"))
    h = "x.h."
    rows = first.select(
        *_item("hackernews", "Hacker News", "HN Algolia · AI 24h", repaired(_first(F.col(f"{h}title"), F.col(f"{h}story_title"))), _first(F.col(f"{h}url"), page), F.coalesce(any_date(F.col(f"{h}created_at"), now), any_date(F.col(f"{h}created_at_i"), now), F.lit(now))),
        "hn_id", F.col("x.query").alias("query"), number(F.col(f"{h}num_comments")).alias("comments"), number(F.col(f"{h}points")).alias("points"),
    )
    return rows.where((F.col("title") != "") & (keyword_score(F.col("title")) >= DISCUSSION_SCORE) & ((F.col("comments") >= DISCUSSION_COMMENTS) | (F.col("points") >= DISCUSSION_POINTS)))


def selected_items(payloads: DataFrame, now: datetime) -> DataFrame:
    """Items of a scored service (pos, body as JSON) with a number of 60 or more, each URL's first one."""
    schema = "items array<struct<id:string,title:string,title_en:string,url:string,source:string,category:string,summary:string,publishedAt:string,score:string,selected:boolean>>"
    found = payloads.select("pos", F.posexplode(F.from_json("body", schema)["items"]).alias("at", "x"))
    score = F.col("x.score").try_cast("double")
    rows = found.where(score >= SELECTED_SCORE).select(
        "pos", "at", *_item("aihot", "AI HOT", repaired(_first(F.col("x.source"), F.lit("AI HOT"))), repaired(_first(F.col("x.title"), F.col("x.title_en"))), stripped(F.col("x.url")), any_date(F.col("x.publishedAt"), now)),
        score.alias("aihot_score"), F.col("x.category").alias("category"), F.coalesce("x.selected", F.lit(False)).alias("selected"), F.col("x.summary").alias("summary"),
    ).where("title <> '' and url <> ''")
    columns = [c for c in rows.columns if c not in ("pos", "at")]
    return rows.groupBy(normalized(F.col("url")).alias("_url")).agg(F.min_by(F.struct(*columns), F.struct("pos", "at")).alias("row")).select("row.*")


def builders(posts: DataFrame, blogs: DataFrame, podcasts: DataFrame, now: datetime) -> DataFrame:
    """Three feeds (body as JSON): posts of builders, articles and episodes; the latter two fall back to their feed's time."""
    x = posts.select(F.explode(F.from_json("body", "x array<struct<name:string,handle:string,tweets:array<struct<text:string,url:string,createdAt:string>>>>")["x"]).alias("b")).select("b.name", "b.handle", F.explode("b.tweets").alias("t"))
    title = squeezed(F.col("t.text"))
    short = F.when(F.length(title) > 220, F.concat(F.regexp_replace(F.left(title, F.lit(217)), r"(?U)\s+$", ""), F.lit("..."))).otherwise(title)
    who = _first(F.col("name"), F.col("handle"))
    source = F.regexp_replace(F.concat(F.lit("Follow Builders · X · "), who), "[ ·]+$", "")
    out = x.select(*_item("followbuilders", "Follow Builders", source, repaired(short), stripped(F.col("t.url")), any_date(F.col("t.createdAt"), now)))
    for frame, key, kind in ((blogs, "blogs", "Blog"), (podcasts, "podcasts", "Podcast")):
        body = F.from_json("body", f"generatedAt string, {key} array<struct<name:string,title:string,url:string,publishedAt:string>>")
        rows = frame.select(body["generatedAt"].alias("made"), F.explode(body[key]).alias("a"))
        source = F.concat(F.lit(f"Follow Builders · {kind} · "), F.coalesce(F.nullif("a.name", F.lit("")), F.lit(kind)))
        out = out.union(rows.select(*_item("followbuilders", "Follow Builders", source, repaired(F.col("a.title")), stripped(F.col("a.url")), F.coalesce(any_date(F.col("a.publishedAt"), now), any_date(F.col("made"), now)))))
    return out.where("title <> '' and url <> '' and published_at is not null")


def breakfast(pages: DataFrame, now: datetime) -> DataFrame:
    """Issues of a newsletter's overview (body as markdown), each URL once."""
    pattern = r"(?s)([A-Z][a-z]{2}\s+\d{1,2},\s+\d{4})\s+•\s+\d+\s+min read\s+###\s+\*\*(.*?)\*\*.*?\]\((https?://aibreakfast\.beehiiv\.com/p/[^)]+)\)"
    rows = _each(pages, F.col("body"), pattern, 3)
    first = rows.groupBy(stripped(F.col("g3")).alias("url")).agg(F.min_by(F.struct("g1", "g2"), "pos").alias("m"))
    items = first.select(*_item("aibreakfast", "AI Breakfast", "AI Breakfast", repaired(squeezed(F.col("m.g2"))), F.col("url"), any_date(F.col("m.g1"), now)))
    return _young(items, now, OFFICIAL_DAYS)


def _dated(html: Column, now: datetime) -> Column:
    attribute, text = F.regexp_extract(html, r"""(?s)<time\b[^>]*datetime=["']([^"']*)["']""", 1), _text_of(F.regexp_extract(html, r"(?s)<time\b[^>]*>(.*?)</time>", 1))
    return any_date(F.when(attribute != "", attribute).otherwise(text), now)


def news_page(pages: DataFrame, now: datetime) -> DataFrame:
    """Links under /news/ with a heading and a time (body as HTML), each once."""
    rows = _each(pages, F.col("body"), r"""(?s)<a\b[^>]*href=["'](/news/[^"']+)["'][^>]*>(.*?)</a>""", 2)
    title = repaired(_text_of(F.regexp_extract("g2", r"(?s)<h[1-4]\b[^>]*>(.*?)</h[1-4]>", 1)))
    rows = rows.withColumn("title", title).where("title <> '' and lower(title) <> 'news'")
    first = rows.groupBy("g1").agg(F.min_by(F.struct("title", "g2"), "pos").alias("m"))
    items = first.select(*_item("official_ai", "Official AI Updates", "Anthropic News", F.col("m.title"), F.concat(F.lit("https://www.anthropic.com"), F.col("g1")), _dated(F.col("m.g2"), now)))
    return _young(items, now, OFFICIAL_DAYS)


def changelog_page(pages: DataFrame, now: datetime) -> DataFrame:
    """List entries with an id, a heading and a time (body as HTML), each id once."""
    rows = _each(pages, F.col("body"), r"""(?s)<li\b[^>]*\bid=["']([^"']+)["'][^>]*>(.*?)(?=<li\b[^>]*\bid=|$)""", 2)
    rows = rows.withColumn("title", repaired(_text_of(F.regexp_extract("g2", r"(?s)<h3\b[^>]*>(.*?)</h3>", 1)))).withColumn("at", _dated(F.col("g2"), now)).where("title <> '' and at is not null")
    first = rows.groupBy(stripped(F.col("g1")).alias("id")).agg(F.min_by(F.struct("title", "at"), "pos").alias("m"))
    url = F.concat(F.lit("https://developers.openai.com/codex/changelog#"), F.col("id"))
    return _young(first.select(*_item("official_ai", "Official AI Updates", "OpenAI Codex Changelog", F.col("m.title"), url, F.col("m.at"))), now, OFFICIAL_DAYS)


def curated_entries(entries: DataFrame, now: datetime) -> DataFrame:
    """Feed entries (feed, pos, title, link, published, keywords, strict, most): young ones that the feed's keywords allow, each URL once, the first `most` a feed."""
    rows = entries.select("feed", "pos", "most", "keywords", "strict", *_item("curated_media", "Curated Media", F.col("feed"), repaired(F.coalesce("title", F.lit(""))), stripped(F.coalesce("link", F.lit(""))), any_date(F.col("published"), now)))
    fit = _young(rows.where("title <> '' and url <> ''"), now, CURATED_DAYS).where(allowed_entry(F.col("keywords"), F.col("strict"), F.col("title"), F.col("url"), F.col("feed")))
    once = fit.groupBy("feed", normalized(F.col("url")).alias("_url")).agg(F.min_by(F.struct(*fit.columns), "pos").alias("row")).select("row.*")
    return first_of_each(once, "feed", "pos", F.greatest(F.lit(1), F.coalesce("most", F.lit(CURATED_ENTRIES)))).drop("pos", "most", "keywords", "strict", "feed")


def first_of_each(rows: DataFrame, key: str, order: str, most: Column) -> DataFrame:
    """The first `most` rows of each key. A window with a bound on its rank keeps no more than that of a hot key in each task before the shuffle."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def channel_posts(pages: DataFrame, now: datetime) -> DataFrame:
    """Messages of public channels (source, slug, body as HTML); undated ones go."""
    rows = _each(pages, F.col("body"), r"""(?s)data-post=["']([^"']+)["'](.*?)(?=data-post=["']|$)""", 2, ("source",))
    said = _text_of(F.regexp_extract("g2", r"""(?s)<div[^>]*class=["'][^"']*tgme_widget_message_text[^"']*["'][^>]*>(.*?)</div>""", 1))
    shown = _text_of(F.regexp_extract("g2", r"""(?s)<div[^>]*class=["'][^"']*link_preview_title[^"']*["'][^>]*>(.*?)</div>""", 1))
    text = F.coalesce(F.nullif(said, F.lit("")), shown)
    rows = rows.select(*_item("opmlrss", "OPML RSS", F.col("source"), cut(text, 96), F.concat(F.lit("https://t.me/"), stripped(F.col("g1"))), _dated(F.col("g2"), now)))
    return rows.where("title <> '' and published_at is not null")


def page_posts(pages: DataFrame, now: datetime) -> DataFrame:
    """Posts in the data that a page (source, body as HTML) carries for its script; undated ones go."""
    data = F.regexp_extract("body", r"""(?s)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)
    schema = "props struct<pageProps:struct<posts:array<struct<id:string,content:string,createdAt:string,actionTime:string>>>>"
    rows = pages.select("source", F.explode(F.from_json(data, schema)["props"]["pageProps"]["posts"]).alias("p"))
    items = rows.select(
        *_item("opmlrss", "OPML RSS", F.col("source"), cut(squeezed(F.col("p.content")), 96), F.concat(F.lit("https://m.okjike.com/originalPosts/"), stripped(F.col("p.id"))), any_date(_first(F.col("p.createdAt"), F.col("p.actionTime")), now)),
        stripped(F.col("p.id")).alias("post_id"),
    )
    return items.where("title <> '' and post_id <> '' and published_at is not null").drop("post_id")


def objects_of(body: str | None) -> Iterator[dict]:
    """Every object of a JSON body before those within it, whatever its depth; none of a body that can't be read."""
    try:
        whole = json.loads(body)
    except (TypeError, ValueError, RecursionError):
        return
    left = [whole]
    while left:
        value = left.pop()
        if isinstance(value, dict):
            yield value
            value = list(value.values())
        if isinstance(value, list):
            left.extend(reversed(value))


def _shallow(value: dict, depth: int) -> dict:
    """An object without lists and without what lies over `depth` objects deep."""
    return {k: _shallow(v, depth - 1) if isinstance(v, dict) else v for k, v in value.items() if not isinstance(v, list) and (depth > 1 or not isinstance(v, dict))}


def nested(body: Column, keys: list[str], wrappers: list[str], depth: int = 3) -> Column:
    """Every object of a JSON body that has one of the keys or wrappers, outer ones first, as JSON of `depth` levels without lists.

    What an object wraps (the first of its wrappers that holds an object) comes with it and not again by itself.
    """
    wanted = {*keys, *wrappers}

    def found(body: str | None) -> list[str]:
        out, inner = [], set()
        for x in objects_of(body):
            child = next((x[w] for w in wrappers if isinstance(x.get(w), dict)), None)
            if child is not None:
                inner.add(id(child))  # all objects of a body are alive until its walk ends
            if id(x) not in inner and not x.keys().isdisjoint(wanted):
                out.append(json.dumps(_shallow(x, depth), ensure_ascii=False))
        return out

    def each(bodies: pd.Series) -> pd.Series:
        return pd.Series([found(b) for b in bodies], dtype=object)

    return F.pandas_udf(each, "array<string>")(body)


#: Keys that make an object a sample of a payload, how many samples, and keys of each.
SAMPLE_KEYS, SAMPLES, SHOWN_KEYS = {"aweme_info", "note_card", "display_title", "desc", "title", "id", "note_id"}, 3, 16
SHAPE = "dict_count long, data_type string, data_keys array<string>, data_items_count long, data_business_count long, aweme_info_count long, note_card_count long, sample_keys array<array<string>>"


def _shape(body: str | None) -> dict:
    counts, samples, top = {"dict_count": 0, "aweme_info_count": 0, "note_card_count": 0}, [], None
    for n, x in enumerate(objects_of(body)):
        top = x if n == 0 and body.lstrip().startswith("{") else top
        counts["dict_count"] += 1
        for key in ("aweme_info", "note_card"):
            counts[f"{key}_count"] += isinstance(x.get(key), dict)
        if len(samples) < SAMPLES and SAMPLE_KEYS & set(keys := sorted(x)[:SHOWN_KEYS]):
            samples.append(keys)
    data = top.get("data") if top else None
    inner = data if isinstance(data, dict) else {}
    size = lambda key: len(inner[key]) if isinstance(inner.get(key), list) else None
    return {**counts, "data_type": type(data).__name__ if data is not None else None, "data_keys": sorted(inner)[:SHOWN_KEYS], "data_items_count": size("items"), "data_business_count": size("business_data"), "sample_keys": samples}


def payload_shapes(payloads: DataFrame) -> DataFrame:
    """payloads (body as JSON) with what they look like, without any value: numbers of objects and of wrapped posts, keys of the data and of some objects."""

    def each(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_shape(b) for b in bodies], columns=[c.split()[0] for c in SHAPE.split(", ")])

    return payloads.withColumn("_s", F.pandas_udf(each, SHAPE)("body")).select(*[c for c in payloads.columns if c != "body"], "_s.*")


def post_key(site: Column, post_id: Column, url: Column, title: Column) -> Column:
    """What a post is known by over all searches: its id, else its URL and title."""
    post = stripped(F.coalesce(post_id, F.lit("")))
    return F.when(post != "", F.concat_ws(":", site, post)).otherwise(F.concat_ws(":", site, normalized(url), stripped(title)))


def metric(*values: Column) -> Column:
    """The first usable count: commas out, fractions cut, 0 at least; 0 if there is none."""
    numbers = [F.replace(stripped(v), F.lit(","), F.lit("")).try_cast("double") for v in values]
    return F.greatest(F.lit(0), F.coalesce(*numbers, F.lit(0.0)).cast("bigint"))


def creator_metrics(platform: str, of) -> Column:
    """likes, comments, collects and shares by the names that a platform gives them; `of` gets a column by name."""
    names = {
        "douyin": {"likes": ["digg_count", "like_count"], "comments": ["comment_count", "comments_count"], "collects": ["collect_count", "collected_count"], "shares": ["share_count", "shared_count"]},
        "xiaohongshu": {"likes": ["liked_count", "likes_count", "like_count", "digg_count"], "comments": ["comments_count", "comment_count"], "collects": ["collected_count", "collect_count"], "shares": ["shared_count", "share_count"]},
    }[platform]
    return F.struct(*(metric(*(of(n) for n in aliases)).alias(k) for k, aliases in names.items()))


def _generic_sound(title: Column) -> Column:
    return title.rlike(r"(?i)^@?.{1,80}(创作的原声|的原声|original\s+sound)$")


def videos(payloads: DataFrame, now: datetime) -> DataFrame:
    """Videos anywhere in search results (pos, body as JSON), wrapped or bare: each id's first one with a title of its own."""
    times = ["create_time", "create_time_stamp", "createTime", "createTimeStamp", "created_at", "publish_time", "publishTime", "publish_timestamp", "time"]
    counts = ["digg_count", "like_count", "comment_count", "comments_count", "collect_count", "collected_count", "share_count", "shared_count"]
    fields = ["aweme_id", "awemeId", "desc", "title", "caption", "share_url", *times]
    video = ",".join(f"{f}:string" for f in fields) + f",share_info:struct<share_desc:string,share_title:string,share_url:string>,author:struct<nickname:string,unique_id:string>,statistics:struct<{','.join(f'{c}:string' for c in counts)}>"
    found = nested(F.col("body"), ["aweme_id", "awemeId"], ["aweme_info"])
    rows = payloads.select("pos", F.posexplode(found).alias("at", "j")).select("pos", "at", F.coalesce(F.from_json("j", f"aweme_info struct<{video}>")["aweme_info"], F.from_json("j", f"struct<{video}>")).alias("v"))
    told = F.array(*(F.coalesce(f"v.{c}", F.lit("")) for c in ("desc", "title", "caption", "share_info.share_desc", "share_info.share_title")))
    title = F.get(F.filter(F.transform(told, lambda t: snippet(t, 220)), lambda t: (t != "") & ~_generic_sound(t)), 0)
    post = _first(F.col("v.aweme_id"), F.col("v.awemeId"))
    url = _first(F.col("v.share_url"), F.col("v.share_info.share_url"), F.concat(F.lit("https://www.douyin.com/video/"), post))
    readable = F.filter(F.transform(F.array(*(F.col(f"v.{t}") for t in times)), lambda t: epoch_or_date(t, now)), lambda t: t.isNotNull())
    at = F.coalesce(F.get(readable, 0), F.lit(now))
    items = rows.select("pos", "at", post.alias("post_id"), *_item("tikhub_douyin", "TikHub Douyin", _first(F.col("v.author.nickname"), F.col("v.author.unique_id"), F.lit("Douyin Search")), title, url, at), creator_metrics("douyin", lambda n: F.col(f"v.statistics.{n}")).alias("creator_metrics"))
    items = items.where("title is not null and post_id <> ''")
    return items.groupBy("post_id").agg(F.min_by(F.struct(*[c for c in items.columns if c not in ("pos", "at", "post_id")]), F.struct("pos", "at")).alias("row")).select("post_id", "row.*")


#: What a note is wrapped in, and the names of what it tells.
NOTE_KEYS = ["note_card", "note_info", "note", "note_data", "noteCard"]
NOTE_IDS, NOTE_LINKS = ["note_id", "noteId", "id"], ["url", "share_url", "shareUrl"]
NOTE_TITLES = ["display_title", "displayTitle", "title", "desc", "description", "content"]
NOTE_TIMES = ["time", "create_time", "created_at", "last_update_time", "createTime", "createdAt", "lastUpdateTime", "publish_time", "publishTime"]
NOTE_COUNTS = ["liked_count", "likes_count", "like_count", "digg_count", "comments_count", "comment_count", "collected_count", "collect_count", "shared_count", "share_count"]
OWNERS = ["nickname", "nick_name", "nickName", "name"]


def notes(payloads: DataFrame, now: datetime) -> DataFrame:
    """Notes anywhere in search results (pos, body as JSON), wrapped or bare: each id's first one with a title, with a credible time or that of its id."""
    strings = lambda names: [f"{n}:string" for n in names]
    own = "map<string,string>"  # two of the names differ in case alone
    note = ",".join([*strings(dict.fromkeys([*NOTE_IDS, *NOTE_TITLES, *NOTE_LINKS, *NOTE_TIMES, *NOTE_COUNTS, "xsec_token"])), f"user:{own}", f"user_info:{own}", f"interact_info:struct<{','.join(strings(NOTE_COUNTS))}>"])
    found = nested(F.col("body"), NOTE_IDS, NOTE_KEYS)
    rows = payloads.select("pos", F.posexplode(found).alias("at", "j")).select("pos", "at", F.from_json("j", f"struct<{note}>").alias("o"), F.from_json("j", f"struct<{','.join(f'{k}:struct<{note}>' for k in NOTE_KEYS)}>").alias("w"))
    rows = rows.select("pos", "at", "o", F.coalesce(*(F.col(f"w.{k}") for k in NOTE_KEYS), "o").alias("n"))
    of = lambda *names: F.coalesce(*(F.nullif(n, F.lit("")) for n in names), F.lit(""))
    post = stripped(of(*(f"n.{k}" for k in NOTE_IDS), "o.noteId", "o.note_id", "o.id"))
    title = snippet(of(*(f"n.{k}" for k in NOTE_TITLES), "o.display_title", "o.title", "o.desc"), 220)
    user = F.coalesce("n.user", "n.user_info", "o.user", "o.user_info")
    source = F.coalesce(F.nullif(stripped(of(*(F.try_element_at(user, F.lit(k)) for k in OWNERS))), F.lit("")), F.lit("Xiaohongshu Search"))
    token = stripped(of("n.xsec_token", "o.xsec_token"))
    page = F.concat(F.lit("https://www.xiaohongshu.com/explore/"), post, F.when(token != "", F.concat(F.lit("?xsec_token="), token)).otherwise(""))
    url = _first(*(F.col(f"{x}.{k}") for x in "no" for k in NOTE_LINKS), page)
    first_time = lambda x: F.get(F.filter(F.transform(F.array(*(F.col(f"{x}.{t}") for t in NOTE_TIMES)), lambda t: epoch_or_date(t, now)), lambda t: t.isNotNull()), 0)
    at = F.coalesce(credible(first_time("n"), now), credible(first_time("o"), now), note_id_time(post, now))
    items = rows.select("pos", "at", post.alias("post_id"), *_item("tikhub_xiaohongshu", "TikHub Xiaohongshu", source, title, url, at), creator_metrics("xiaohongshu", lambda c: F.coalesce(f"n.interact_info.{c}", f"n.{c}", f"o.{c}")).alias("creator_metrics")).where("title <> '' and post_id <> ''")
    return items.groupBy("post_id").agg(F.min_by(F.struct(*[c for c in items.columns if c not in ("pos", "at", "post_id")]), F.struct("pos", "at")).alias("row")).select("post_id", "row.*")


def note_time(published: Column, note_id: Column, now: datetime) -> Column:
    """A note's time if credible, else what its id tells."""
    return F.coalesce(credible(epoch_or_date(published, now), now), note_id_time(note_id, now))


def capped(items: DataFrame, total: int, per_platform: int, per_keyword: int) -> DataFrame:
    """Items (platform, keyword, pos) within a limit for each keyword of a platform, then for each platform, then in all."""
    from pyspark.sql import Window

    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    rows = items.withColumn("_n", rank("platform", "keyword")).where(F.col("_n") <= per_keyword).withColumn("_n", rank("platform")).where(F.col("_n") <= per_platform)
    return rows.drop("_n").orderBy("pos").limit(total)


def hub_records(items: DataFrame) -> DataFrame:
    """items (id, site_id, title, url, event_time) of which those of one site are left once a URL: telling titles first, then the newest, then the greatest id."""
    own = F.coalesce(F.col("site_id") == "aihubtoday", F.lit(False))
    rows = items.where(own).withColumn("_url", normalized(F.coalesce("url", F.lit("")))).where("_url <> ''")
    best = F.struct(~generic_title(F.col("title")), F.coalesce(F.unix_micros("event_time"), F.lit(-(1 << 62))), F.col("id"))
    return items.where(~own).union(rows.groupBy("_url").agg(F.max_by(F.struct(*items.columns), best).alias("row")).select("row.*"))


def resolved_feeds(feeds: DataFrame) -> DataFrame:
    """feeds (feed_url, page_url) with effective_url and note: replaced, left out (null) or as it is; and the public page that stands in for one."""
    url, page = stripped(F.coalesce("feed_url", F.lit(""))), stripped(F.coalesce("page_url", F.lit("")))
    replaced = F.element_at(F.create_map(*(F.lit(x) for pair in FEED_REPLACEMENTS.items() for x in pair)), url)
    skipped = F.exists(F.array(*map(F.lit, FEED_SKIP_PREFIXES)), lambda p: F.startswith(url, p))
    note = F.when(url == "", "empty_url").when(url.isin(FEED_SKIP_EXACT), "no_official_rss_or_unreachable").when(skipped, "no_official_rss_for_source_type").when(replaced.isNotNull(), "official_replacement")
    effective = F.when(note.isNull() | (note == "official_replacement"), F.coalesce(replaced, url))
    slug = lambda p: F.nullif(F.regexp_extract(url, rf"^https?://rsshub\.app/+{p}/([^/?#]+)", 1), F.lit(""))
    channel, topic, user = slug("telegram/channel"), slug("jike/topic"), slug("jike/user")
    home = lambda head: F.when(F.startswith(page, F.lit(head)), page)
    bridge = F.coalesce(
        F.concat(F.lit("https://t.me/s/"), channel), F.concat(F.lit("https://m.okjike.com/topics/"), topic), F.concat(F.lit("https://m.okjike.com/users/"), user),
        home("https://t.me/s/"), home("https://m.okjike.com/topics/"), home("https://m.okjike.com/users/"),
    )
    return feeds.withColumns({"effective_url": effective, "note": note, "bridge_url": bridge})
