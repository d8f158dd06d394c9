"""Queries over landed payloads: the given tables written as payloads, parsed back, and the same rows as DuckDB SQL from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions import vocabulary as v
from ..functions.text import bigram_tokens, clean_review, displayed_source, needs_context, overlap_entities, overlap_title, reading_length, repaired
from ..functions.urls import host_of
from ..operators import status
from ..sources import payloads
from .items import ITEMS_SQL, NOW, NOW_S, START_S, document_items, table
from .queries import SCORED_SQL, Query, scored_items

MINUTE = 60


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], k: str) -> str:
    return f"list_extract({values}, cast({k} % {len(values)} + 1 as integer))"


def _utc(seconds: Column, pattern: str) -> Column:
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), pattern)


def _seconds(at: Column) -> Column:
    return F.unix_seconds(at)


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in sixteen forms, read back."""
    n = F.col("event_id").cast("bigint")
    at = F.lit(START_S) - n * 61
    text = lambda c: c.cast("string")
    forms = [
        text(at), text(at * 1000), F.concat(text(n % 60), F.lit("分钟前")), F.concat(text(n % 24), F.lit(" 小时前")), F.concat(text(n % 30), F.lit("天前")), F.lit("刚刚"), F.lit("昨天 10:00"),
        _utc(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), _utc(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), _utc(at, "yyyy-MM-dd hh:mm:ssa 'UTC'"), F.concat(F.lit("今天 "), text(F.floor(n % 1440 / 60)), F.lit(":"), F.lpad(text(n % 60), 2, "0")),
        F.concat(text(n % 12 + 1), F.lit("月"), text(n % 28 + 1), F.lit("日")), _utc(at, "yyyy-MM-dd'T'HH:mm:ss'+08:00'"), F.concat(F.lit("$D"), _utc(at, "yyyy-MM-dd'T'HH:mm:ss'.500Z'")), _utc(at, "dd MMM yyyy HH:mm:ss 'EST'"), F.lit("no date 12:99"),
    ]
    told = F.element_at(F.array(*forms), (n % len(forms) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", told.alias("told"))
    return rows.select("event_id", F.unix_millis(times.any_date(F.col("told"), NOW)).alias("millis"))


DATE_FORMS_SQL = f"""
with e as (select event_id, event_id as n, {START_S} - event_id * 61 as at_, event_id % 16 as f from events)
select event_id, cast(case f when 0 then at_ * cast(1000 as bigint) when 1 then at_ * cast(1000 as bigint) when 2 then ({NOW_S} - (n % 60) * 60) * cast(1000 as bigint) when 3 then ({NOW_S} - (n % 24) * 3600) * cast(1000 as bigint) when 4 then ({NOW_S} - (n % 30) * 86400) * cast(1000 as bigint)
  when 5 then {NOW_S} * cast(1000 as bigint) when 6 then ({NOW_S} - 86400) * cast(1000 as bigint) when 7 then at_ * cast(1000 as bigint) when 8 then at_ * cast(1000 as bigint) when 9 then at_ * cast(1000 as bigint)
  when 10 then ({NOW_S} + (n % 1440) // 60 * 3600 + n % 60 * 60 - case when (n % 1440) // 60 * 3600 + n % 60 * 60 > 300 then 86400 else 0 end) * cast(1000 as bigint)
  when 11 then epoch(make_timestamp(case when make_timestamp(2024, n % 12 + 1, n % 28 + 1, 0, 0, 0) > make_timestamp(cast({NOW_S} + 172800 as bigint) * 1000000) then 2023 else 2024 end, n % 12 + 1, n % 28 + 1, 0, 0, 0)) * cast(1000 as bigint)
  when 12 then (at_ - 28800) * cast(1000 as bigint) when 13 then at_ * cast(1000 as bigint) + 500 when 14 then (at_ + 18000) * cast(1000 as bigint) end as bigint) as millis
from e
"""


def feed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of feeds that run ahead, corrected feed by feed."""
    n, size = F.col("event_id"), F.length("event_type")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.timestamp_seconds(F.lit(NOW_S) + size % 4 * 9000 - n % 600 * MINUTE).alias("published_at"))
    return times.corrected_feeds(rows, "event_type", "published_at", NOW, F.length("event_type") % 2 == 0).select("event_id", _seconds(F.col("published_at")).alias("published"))


FEED_TIMES_SQL = f"""
with e as (select event_id, event_type, length(event_type) % 2 = 0 as zh, {NOW_S} + length(event_type) % 4 * 9000 - event_id % 600 * 60 as p from events), m as (select event_type, max(p) as top from e group by 1)
select event_id, cast(case when zh and top > {NOW_S} + 7200 and top - 28800 <= {NOW_S} + 7200 then p - 28800 when p <= {NOW_S} + 7200 then p when zh and p - 28800 <= {NOW_S} + 7200 then p - 28800 else {NOW_S} end as bigint) as published
from e join m using (event_type)
"""


def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read in a wrong encoding, read again."""
    text = F.coalesce("text", F.lit(""))
    wrong = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(repaired(F.concat(F.lit("<"), wrong, F.lit(">")))).alias("text_md5"))


REPAIRED_TEXTS_SQL = "select doc_id, md5('<' || coalesce(text, '') || '>') as text_md5 from documents"

_TITLES = ["OpenAI and Claude at work", "GPT model eval", "nothing to see", "LLM agent paper"]


def discussion_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    hit = F.struct((n % 700).cast("string").alias("objectID"), _pick(_TITLES, n).alias("title"), (n % 5).alias("num_comments"), (n % 17).alias("points"), F.when(n % 3 > 0, F.concat(F.lit("https://h.example/"), n.cast("string"))).alias("url"), (F.lit(START_S) - n).alias("created_at_i"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), n.alias("pos"), F.to_json(F.struct(F.array(hit).alias("hits"))).alias("body"))
    return payloads.discussions(rows, NOW).select("hn_id", "query", "title", "url", "comments", "points", _seconds(F.col("published_at")).alias("published"))


DISCUSSION_HITS_SQL = f"""
with first as (select *, row_number() over (partition by event_id % 700 order by event_id) as k from events)
select cast(event_id % 700 as varchar) as hn_id, event_type as query, {_sql_pick(_TITLES, 'event_id')} as title,
       case when event_id % 3 > 0 then 'https://h.example/' || cast(event_id as varchar) else 'https://news.ycombinator.com/item?id=' || cast(event_id % 700 as varchar) end as url,
       cast(event_id % 5 as integer) as comments, cast(event_id % 17 as integer) as points, cast({START_S} - event_id as bigint) as published
from first where k = 1 and event_id % 4 <> 2 and (event_id % 5 >= 2 or event_id % 17 >= 10)
"""


def selected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    score = F.when(n % 11 == 0, F.lit("true")).when(n % 13 == 0, F.lit('"x"')).otherwise((n % 100 + 0.5).cast("string"))
    url = F.concat(F.lit("https://S.example/"), (n % 900).cast("string"), F.lit("?utm_medium=m&a="), (n % 2).cast("string"))
    title = F.concat(F.lit('"t'), n.cast("string"), F.lit('"'))
    body = F.concat(F.lit('{"items":[{"score":'), score, F.lit(',"url":"'), url, F.lit('","title":'), F.when(n % 7 == 0, F.lit("null")).otherwise(title), F.lit(',"title_en":"en","publishedAt":"'), _utc(F.lit(START_S) - n, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}]}'))
    rows = table(spark, sf_dir, "events").select(n.alias("pos"), body.alias("body"))
    return payloads.selected_items(rows, NOW).select("source", "title", "url", "aihot_score", _seconds(F.col("published_at")).alias("published"))


SELECTED_ITEMS_SQL = f"""
with e as (
  select event_id as n, event_id % 100 + 0.5 as score, row_number() over (partition by event_id % 900, event_id % 2 order by event_id) as k from events where event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 100 + 0.5 >= 60
)
select 'AI HOT' as source, case when n % 7 = 0 then 'en' else 't' || cast(n as varchar) end as title, 'https://S.example/' || cast(n % 900 as varchar) || '?utm_medium=m&a=' || cast(n % 2 as varchar) as url,
       cast(score as double) as aihot_score, cast({START_S} - n as bigint) as published
from e where k = 1
"""


def builder_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    at = F.lit("2024-01-01T10:00:00Z")
    url = F.concat(F.lit("https://b.example/"), F.col("k"))
    tweet = F.struct("text", url.alias("url"), at.alias("createdAt"))
    posts = said.select(F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")).alias("name"), F.lit("h").alias("handle"), F.array(tweet).alias("tweets"))).alias("x"))).alias("body"))
    article = F.struct(F.when(F.col("turn") % 2 == 0, "Daily").alias("name"), F.concat(F.lit("t "), F.col("k")).alias("title"), url.alias("url"), F.when(F.col("turn") % 3 == 0, at).alias("publishedAt"))
    blogs = said.select(F.to_json(F.struct(F.lit("2024-01-01T12:00:00Z").alias("generatedAt"), F.array(article).alias("blogs"))).alias("body"))
    podcasts = said.select(F.to_json(F.struct(F.array(article).alias("podcasts"))).alias("body"))
    return payloads.builders(posts, blogs, podcasts, NOW).select("source", F.md5("title").alias("title_md5"), "url", _seconds(F.col("published_at")).alias("published"))


_SQUEEZED = "trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
BUILDER_ITEMS_SQL = f"""
with c as (select cast(conv_id as varchar) || '-' || cast(turn as varchar) as k, turn, {_SQUEEZED.format(t="coalesce(text, '')")} as s from conversations), a as (select *, 'https://b.example/' || k as url from c)
select 'Follow Builders · X · n' || cast(turn as varchar) as source, md5(case when length(s) > 220 then rtrim(left(s, 217)) || '...' else s end) as title_md5, url, cast({START_S} + 36000 as bigint) as published from a where s <> ''
union all select 'Follow Builders · Blog · ' || case when turn % 2 = 0 then 'Daily' else 'Blog' end, md5('t ' || k), url, cast({START_S} + case when turn % 3 = 0 then 36000 else 43200 end as bigint) from a
union all select 'Follow Builders · Podcast · ' || case when turn % 2 = 0 then 'Daily' else 'Podcast' end, md5('t ' || k), url, cast({START_S} + 36000 as bigint) from a where turn % 3 = 0
"""


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of five kinds of pages."""
    n = F.col("page_id")
    k, old = n.cast("string"), F.lit(NOW_S) - n % 60 * 86400
    iso, day = _utc(old, "yyyy-MM-dd'T'HH:mm:ss'Z'"), _utc(old, "MMM d, yyyy")
    rows = table(spark, sf_dir, "pages").select("page_id")
    body = lambda *parts: rows.select(F.lit("src").alias("source"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("body"))
    news = body('<p><a class="c" href="/news/n', k, '"><div><h3>News <b>', k, '</b></h3></div><time datetime="', iso, '">x</time></a><a href="/news/n', k, '"><h2>again</h2></a><a href="/news/none">no heading</a></p>')
    log = body('<ul><li id="v', k, '"><h3>Version ', k, "</h3><time>", day, '</time></li><li id="w"><h3>undated</h3></li></ul>')
    mail = body(day, " • 4 min read ### **Issue  ", k, "** some words ![](x) [read](https://aibreakfast.beehiiv.com/p/i", k, ")\n")
    chat = body('<div class="tgme_widget_message " data-post="ch/', k, '"><div class="tgme_widget_message_text js">Said <i>', k, '</i></div><time datetime="', iso, '"></time></div><div data-post="ch/x"><div class="tgme_widget_message_text">undated</div></div>')
    posts = body('<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"posts":[{"id":"p', k, '","content":"Post  ', k, '","createdAt":"', iso, '"},{"id":"","content":"x"}]}}}</script>')
    out = None
    for kind, part in (("news", payloads.news_page(news, NOW)), ("log", payloads.changelog_page(log, NOW)), ("mail", payloads.breakfast(mail, NOW)), ("chat", payloads.channel_posts(chat, NOW)), ("posts", payloads.page_posts(posts, NOW))):
        found = part.select(F.lit(kind).alias("kind"), "title", "url", _seconds(F.col("published_at")).alias("published"))
        out = found if out is None else out.union(found)
    return out


PAGE_ITEMS_SQL = f"""
with p as (select page_id as n, cast(page_id as varchar) as k, {NOW_S} - page_id % 60 * 86400 as at_, page_id % 60 <= 45 as young from pages)
select 'news' as kind, 'News ' || k as title, 'https://www.anthropic.com/news/n' || k as url, cast(at_ as bigint) as published from p where young
union all select 'log', 'Version ' || k, 'https://developers.openai.com/codex/changelog#v' || k, cast(at_ as bigint) from p where young
union all select 'mail', 'Issue ' || k, 'https://aibreakfast.beehiiv.com/p/i' || k, cast(at_ as bigint) from p where young
union all select 'chat', 'Said ' || k, 'https://t.me/ch/' || k, cast(at_ as bigint) from p
union all select 'posts', 'Post ' || k, 'https://m.okjike.com/originalPosts/p' || k, cast(at_ as bigint) from p
"""


def curated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir)
    n = F.col("doc_id")
    entries = items.select(F.col("source").alias("feed"), n.alias("pos"), F.concat(F.lit("T "), F.col("title")).alias("title"), F.concat(F.lit("https://c.example/"), (n % 400).cast("string")).alias("link"), _utc(F.lit(NOW_S) - n % 50 * 86400, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"), F.lit(" The ,ou,").alias("keywords"), (n % 2 == 0).alias("strict"), F.lit(5).alias("most"))
    return payloads.curated_entries(entries, NOW).select("source", F.md5("title").alias("title_md5"), "url", _seconds(F.col("published_at")).alias("published"))


CURATED_ENTRIES_SQL = f"""
with {ITEMS_SQL}, fit as (
  select source, doc_id, trim('T ' || title, chr(32) || chr(9) || chr(10) || chr(13)) as t, 'https://c.example/' || cast(doc_id % 400 as varchar) as url, {NOW_S} - doc_id % 50 * 86400 as at_ from items where doc_id % 50 <= 30
), allowed as (
  select * from fit where contains(lower(t), 'the') or contains(lower(t), 'ou') or (doc_id % 2 <> 0 and (contains(lower(url || ' ' || source), 'the') or contains(lower(url || ' ' || source), 'ou')))
), once as (select *, row_number() over (partition by source, url order by doc_id) as k from allowed), ranked as (select *, row_number() over (partition by source order by doc_id) as n from once where k = 1)
select source, md5(t) as title_md5, url, cast(at_ as bigint) as published from ranked where n <= 5
"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    video = F.struct(
        (n % 800).cast("string").alias("aweme_id"), F.when(n % 4 == 0, F.lit("@x创作的原声")).otherwise(F.concat(F.lit("clip "), n.cast("string"))).alias("desc"), F.when(n % 8 == 0, F.lit("named")).alias("title"),
        (F.lit(START_S) - n).alias("create_time"), F.struct(F.concat(F.lit("u"), (n % 9).cast("string")).alias("nickname")).alias("author"),
        F.struct(F.concat((n % 3).cast("string"), F.lit(",0"), (n % 10).cast("string"), F.lit("1")).alias("digg_count"), (n % 7).alias("comments_count"), F.lit("bad").alias("collect_count"), F.lit(2.9).alias("collected_count"), F.lit(-3).alias("share_count")).alias("statistics"),
    )
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.struct(video.alias("aweme_info")).alias("card")).alias("inner"))).alias("list")).alias("data")))
    rows = table(spark, sf_dir, "events").select(n.alias("pos"), body.alias("body"))
    m = F.col("creator_metrics")
    return payloads.videos(rows, NOW).select("post_id", "source", "title", "url", _seconds(F.col("published_at")).alias("published"), m.likes.alias("likes"), m.comments.alias("comments"), m.collects.alias("collects"), m.shares.alias("shares"))


VIDEOS_SQL = f"""
with e as (select event_id as n, row_number() over (partition by event_id % 800 order by event_id) as k from events where event_id % 4 <> 0 or event_id % 8 = 0)
select cast(n % 800 as varchar) as post_id, 'u' || cast(n % 9 as varchar) as source, case when n % 8 = 0 then 'named' else 'clip ' || cast(n as varchar) end as title, 'https://www.douyin.com/video/' || cast(n % 800 as varchar) as url,
       cast({START_S} - n as bigint) as published, cast(n % 3 * 1000 + n % 10 * 10 + 1 as bigint) as likes, cast(n % 7 as bigint) as comments, cast(2 as bigint) as collects, cast(0 as bigint) as shares
from e where k = 1
"""


def hub_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir)
    n = F.col("doc_id")
    title = F.when(n % 3 == 0, F.lit("查看详情")).when(n % 5 == 0, F.concat("title", F.lit("(AI资讯)"))).otherwise(F.col("title"))
    rows = items.select("id", F.when(n % 2 == 0, F.lit("aihubtoday")).otherwise(F.col("site_id")).alias("site_id"), title.alias("title"), F.concat(F.lit("https://u.example/"), (n % 90).cast("string"), F.lit("?utm_id=1")).alias("url"), "event_time")
    return payloads.hub_records(rows).select("id", "site_id")


HUB_RECORDS_SQL = f"""
with {ITEMS_SQL}, hub as (
  select *, row_number() over (partition by doc_id % 90 order by case when doc_id % 3 = 0 or doc_id % 5 = 0 or trim(title) = '' then 1 else 0 end, at_s desc, id desc) as k from items where doc_id % 2 = 0
)
select id, 'aihubtoday' as site_id from hub where k = 1 union all select id, site_id from items where doc_id % 2 <> 0
"""

_FEEDS = ["https://rsshub.app/36kr/hot-list", "https://rsshub.app/zhihu/x", "https://flak.tedunangst.com/rss", "https://rsshub.app/jike/user/u1", "https://plain.example/feed", "", "https://rsshub.app/telegram/channel/c1"]
_HOMES = ["", "https://t.me/s/home", "https://m.okjike.com/topics/9", "https://else.example/"]


def resolved_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", _pick(_FEEDS, n).alias("feed_url"), _pick(_HOMES, n).alias("page_url"))
    return payloads.resolved_feeds(rows).select("page_id", "effective_url", "note", "bridge_url")


RESOLVED_FEEDS_SQL = f"""
with f as (select page_id, page_id % 7 as f, page_id % 4 as h from pages)
select page_id, case f when 0 then 'https://36kr.com/feed' when 4 then 'https://plain.example/feed' end as effective_url,
       case f when 0 then 'official_replacement' when 1 then 'no_official_rss_for_source_type' when 2 then 'no_official_rss_or_unreachable' when 3 then 'no_official_rss_for_source_type' when 5 then 'empty_url' when 6 then 'no_official_rss_for_source_type' end as note,
       case when f = 3 then 'https://m.okjike.com/users/u1' when f = 6 then 'https://t.me/s/c1' when h = 1 then 'https://t.me/s/home' when h = 2 then 'https://m.okjike.com/topics/9' end as bridge_url
from f
"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(n % 10 == 0, F.lit("xapi")).otherwise(F.concat(F.lit("s"), n.cast("string"))).alias("site_id"), F.concat(F.lit("S"), n.cast("string")).alias("site_name"), (n % 7 > 0).alias("ok"), F.greatest(F.lit(0), n % 9 - 4).alias("item_count"),
        F.when(n % 3 > 0, n % 11 == 0).alias("skipped"), (n % 13 == 0).alias("replaced"), F.floor(F.abs("value")).alias("duration_ms"),
    )


_STATUSES = (
    "s as (select case when event_id % 10 = 0 then 'xapi' else 's' || cast(event_id as varchar) end as site_id, 'S' || cast(event_id as varchar) as site_name, event_id % 7 > 0 as ok, greatest(0, event_id % 9 - 4) as item_count, "
    "event_id % 3 > 0 and event_id % 11 = 0 as skipped, event_id % 13 = 0 as replaced, cast(floor(abs(value)) as bigint) as duration_ms from events)"
)


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.state_counts(_statuses(spark, sf_dir))


STATUS_ROLLUP_SQL = f"""
with {_STATUSES}
select case when not ok then 'failed' when skipped then 'skipped' when item_count = 0 and site_id = 'xapi' then 'empty_optional' when item_count = 0 then 'empty' else 'fine' end as state, count(*) as sites, cast(sum(item_count) as bigint) as items
from s group by 1
"""


def feed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.feed_summary(_statuses(spark, sf_dir))


FEED_SUMMARY_SQL = f"""
with {_STATUSES}
select count(*) as feeds, count_if(not skipped) as effective, count_if(ok and not skipped) as fine, count_if(not ok) as failed, count_if(skipped) as skipped, count_if(replaced) as replaced, count_if(ok and not skipped and item_count = 0) as empty,
       cast(sum(duration_ms) as bigint) as duration_ms from s
"""


def site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with and without items, in the order of the status list."""
    items = scored_items(spark, sf_dir)
    asked = _statuses(spark, sf_dir).where("item_count > 3")
    return status.site_table(items, items.where("ai_is_related"), asked)


SITE_TABLE_SQL = f"""
with {SCORED_SQL}, {_STATUSES}, r as (select site_id, max(source) as n, count(*) as raw_count, count_if(ai_is_related) as c from scored group by 1), o as (select site_id, max(site_name) as n from s where item_count > 3 group by 1)
select coalesce(r.site_id, o.site_id) as site_id, coalesce(r.n, o.n) as site_name, coalesce(r.c, 0) as count, coalesce(r.raw_count, 0) as raw_count from r full join o on r.site_id = o.site_id
"""


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = scored_items(spark, sf_dir)
    return status.totals(items, items.where("ai_is_related"))


RUN_TOTALS_SQL = f"with {SCORED_SQL} select count(*) as total_raw, count_if(ai_is_related) as total, count(distinct case when ai_is_related then site_id || '::' || source end) as sources from scored"


def capped_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("platform"), (F.col("event_id") % 6).alias("keyword"))
    return payloads.capped(rows, total=60, per_platform=25, per_keyword=8)


CAPPED_POSTS_SQL = """
with a as (select event_id as pos, event_type as platform, event_id % 6 as keyword, row_number() over (partition by event_type, event_id % 6 order by event_id) as n from events),
b as (select *, row_number() over (partition by platform order by pos) as m from a where n <= 8)
select pos, platform, keyword from b where m <= 25 order by pos limit 60
"""


def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as sources are compared and audited by, their length for readers, and what else is derived from them."""
    n = F.col("doc_id")
    extra = _pick(["", " - AI HOT", " | 2024 OpenAI 模型", " (2023)", " [Exclusive] claude — Hacker News."], n)
    items = document_items(spark, sf_dir).withColumn("t", F.concat(F.left("title", F.lit(40)), extra))
    t, normal = F.col("t"), overlap_title(F.col("t"))
    tier = _pick(["community", "official", "other"], n)
    return items.select(
        "doc_id", normal.alias("normal"), F.array_join(F.array_sort(overlap_entities(normal)), "|").alias("entities"), F.array_join(F.array_sort(bigram_tokens(t)), "|").alias("tokens"), reading_length(t).alias("reading_length"),
        needs_context(F.col("site_id"), tier, F.lit(""), t).alias("needs_context"), displayed_source(F.lit("buzzing"), _pick(["", "Buzzing", "own"], n), host_of(F.col("url"))).alias("shown_source"), clean_review(F.concat(t, F.lit("\x07 x"))).alias("review"),
    )


_T = "left(title, 40) || " + _sql_pick(["", " - AI HOT", " | 2024 OpenAI 模型", " (2023)", " [Exclusive] claude — Hacker News."], "doc_id")
_SUFFIX = "|".join(v.OVERLAP_SUFFIXES)
_HAN = r"[\x{4e00}-\x{9fff}]"
TITLE_FORMS_SQL = rf"""
with {ITEMS_SQL}, t0 as (select *, {_T} as t, {_sql_pick(['community', 'official', 'other'], 'doc_id')} as tier from items), t1 as (
  select *, trim(lower(t), chr(32) || chr(9) || chr(13)) as low from t0
), t2 as (
  select *, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(low, '\s+[—–-]\s+({_SUFFIX})[ .]*$', ''), '\[(exclusive|breaking|update|news)\]', ' ', 'g'), '\b20\d\d\b', ' ', 'g'), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'), ' '),
         lambda w: w <> '' and not list_contains({v.OVERLAP_DROPPED}, w)) as words, string_split(regexp_replace(lower(t), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'), ' ') as chunks, trim(t, chr(32) || chr(9) || chr(13)) as s from t1
), t3 as (
  select *, list_filter(list_transform(chunks, lambda c: regexp_replace(c, '{_HAN}', '', 'g')), lambda w: length(w) > 1 and not list_contains({v.AUDIT_STOPWORDS}, w)) as latin,
         flatten(list_transform(list_filter(list_transform(chunks, lambda c: regexp_replace(c, '[a-z0-9]', '', 'g')), lambda w: w <> ''), lambda c: case when length(c) = 1 then [c] else list_transform(range(1, length(c)), lambda k: substr(c, cast(k as integer), 2)) end)) as han from t2
)
select doc_id, array_to_string(words, ' ') as normal, array_to_string(list_sort(list_filter({v.OVERLAP_ENTITIES}, lambda e: list_contains(words, e))), '|') as entities, array_to_string(list_sort(list_distinct(list_concat(latin, han))), '|') as tokens,
       cast(len(regexp_extract_all(t, '{_HAN}')) + coalesce(list_sum(list_transform(regexp_extract_all(t, '[A-Za-z0-9.+-]+'), lambda x: case when regexp_matches(x, '[A-Za-z]') then 2 else 1 end)), 0) as integer) as reading_length,
       case when site_id = 'official_ai' or tier = 'official' then false when tier = 'community' and regexp_matches(s, '[(（]20\d\d[)）]\s*$') then true when regexp_matches(s, '{_HAN}') and length(s) >= 12 then false
            when not regexp_matches(s, '{_HAN}') and len(regexp_extract_all(s, '[A-Za-z]')) >= greatest(6, length(s) // 4) and len(regexp_extract_all(s, '\S+')) <= 4 then true
            else tier = 'community' and ((s <> '' and length(s) < 18) or regexp_matches(s, '[(（]20\d\d[)）]\s*$')) end as needs_context,
       case doc_id % 3 when 2 then 'own' else 'news.example' end as shown_source, left(trim(regexp_replace(t || chr(7) || ' x', '[\x00-\x1f\x7f]', '', 'g'), ' '), 60) as review
from t3
"""

#: name: (query, SQL or None)
LANDING: dict[str, tuple[Query, str | None]] = {
    "date_forms": (date_forms, DATE_FORMS_SQL),
    "feed_times": (feed_times, FEED_TIMES_SQL),
    "repaired_texts": (repaired_texts, REPAIRED_TEXTS_SQL),
    "discussion_hits": (discussion_hits, DISCUSSION_HITS_SQL),
    "selected_items": (selected_items, SELECTED_ITEMS_SQL),
    "builder_items": (builder_items, BUILDER_ITEMS_SQL),
    "page_items": (page_items, PAGE_ITEMS_SQL),
    "curated_entries": (curated_entries, CURATED_ENTRIES_SQL),
    "videos": (videos, VIDEOS_SQL),
    "hub_records": (hub_records, HUB_RECORDS_SQL),
    "resolved_feeds": (resolved_feeds, RESOLVED_FEEDS_SQL),
    "status_rollup": (status_rollup, STATUS_ROLLUP_SQL),
    "feed_summary": (feed_summary, FEED_SUMMARY_SQL),
    "site_table": (site_table, SITE_TABLE_SQL),
    "run_totals": (run_totals, RUN_TOTALS_SQL),
    "capped_posts": (capped_posts, CAPPED_POSTS_SQL),
    "title_forms": (title_forms, TITLE_FORMS_SQL),
}
