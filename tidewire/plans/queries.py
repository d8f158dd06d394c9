"""Every query of the library by name, and the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.scores import importance, with_creator_ranking, with_relevance, with_tier
from ..functions.text import jaccard, mergeable, mostly_english, redacted, snippet, title_tokens
from ..functions.urls import canonical, host_of, normalized, public
from ..operators import archive, audit, dedup, govern, overlap, stories
from ..operators.graph import written
from ..sources.landing import html_context, reader_context
from .items import ITEMS_SQL, NOW, NOW_S, SITES, START_S, document_items, snapshot, table

Query = Callable[[SparkSession, str], DataFrame]


def _micros(column: str):
    return F.unix_micros(column)


def top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most authoritative, newest distinct pages."""
    pages = table(spark, sf_dir, "pages")
    site = F.element_at(F.array(*map(F.lit, SITES)), (F.col("page_id") % len(SITES) + 1).cast("int"))
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    items = pages.select("page_id", site.alias("site_id"), F.lit("page").alias("source"), title.alias("title"), "url", F.timestamp_seconds(F.lit(START_S) + F.col("page_id") * 60).alias("event_time"))
    items = archive.fits(items).withColumn("id", archive.item_id(*(F.col(c) for c in ("site_id", "source", "title", "url"))))
    best = dedup.distinct_items(items).orderBy(*dedup.tier_order()).limit(30)
    return best.select("id", "page_id", "site_id", "title", normalized(F.col("url")).alias("url"))


_PAIRS = "string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')"
_QUERY = "list_transform(list_filter({pairs}, lambda p: p <> '' and {keep}), lambda p: case when contains(p, '=') then p else p || '=' end)"
_TRACKED = f"not (starts_with(lower(split_part(p, '=', 1)), 'utm_') or list_contains({v.TRACKING_KEYS}, lower(split_part(p, '=', 1))))"
_IDENTITY = f"list_contains({v.IDENTITY_KEYS}, lower(split_part(p, '=', 1)))"
_SENSITIVE = f"not list_contains({v.SENSITIVE_QUERY_KEYS}, regexp_replace(lower(split_part(p, '=', 1)), '[^a-z0-9]', '', 'g'))"


def _rebuilt(keep: str) -> str:
    query = f"array_to_string({_QUERY.format(pairs=_PAIRS, keep=keep)}, '&')"
    return f"(regexp_replace(url, '[?#].*$', '') || case when {query} <> '' then '?' || {query} else '' end)"


TOP_ITEMS_SQL = f"""
with pages_in as (
  select page_id, url, list_extract({SITES}, cast(page_id % {len(SITES)} + 1 as integer)) as site_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') as title
  from pages
), named as (
  select *, rtrim({_rebuilt(_TRACKED)}, '/') as n from pages_in where trim(title) <> '' and url like 'http%'
), keyed as (
  select *, sha1(site_id || '||page||' || lower(trim(title)) || '||' || n) as id,
         case site_id when 'official_ai' then 0 when 'aibase' then 1 when 'curated_media' then 2 when 'opmlrss' then 3 else 5 end as r
  from named
), best as (
  select *, row_number() over (partition by lower(trim(title)), n order by r, page_id desc, title, id) as k from keyed
)
select id, page_id, site_id, title, n as url from best where k = 1 order by r, page_id desc, title, id limit 30
"""


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", host_of(url).alias("host"), normalized(url).alias("normalized"), canonical(url).alias("canonical"), public(url).alias("public"))


URL_FORMS_SQL = f"""
select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host, rtrim({_rebuilt(_TRACKED)}, '/') as normalized,
       rtrim({_rebuilt(_IDENTITY)}, '/') as canonical, {_rebuilt(_SENSITIVE)} as public
from pages
"""


def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    tokens = F.array_sort(title_tokens(t))
    return document_items(spark, sf_dir).select("doc_id", F.array_join(tokens, " ").alias("tokens"), mergeable(t).alias("mergeable"), mostly_english(t).alias("english"))


TITLE_WORDS_SQL = rf"""
with {ITEMS_SQL}, cut as (
  select doc_id, title, list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(title), 'https?://\S+', ' ', 'g'), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]{{2,}}'),
         lambda t: length(t) >= 2 and not list_contains({v.TITLE_STOPWORDS}, t)))) as tokens from items
)
select doc_id, array_to_string(tokens, ' ') as tokens, len(tokens) >= 4 and length(trim(title)) >= 18 as mergeable,
       not regexp_matches(title, '[\x{{4e00}}-\x{{9fff}}]') and len(regexp_extract_all(title, '[A-Za-z]')) >= greatest(6, length(trim(title, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) // 4) as english
from cut
"""


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = redacted(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), (clean != F.coalesce("text", F.lit(""))).alias("changed"))


_RE2_SECRET = v.SECRET_PATTERN.replace(r"(?!hynix\b)", "").removeprefix("(?i)")
REDACTION_SQL = f"""
with clean as (
  select doc_id, coalesce(text, '') as text,
         regexp_replace(regexp_replace(coalesce(text, ''), '{v.EMAIL_PATTERN}', '[redacted-email]', 'g'), '{_RE2_SECRET}', '[redacted-secret]', 'gi') as clean
  from documents
)
select doc_id, md5(clean) as clean_md5, clean <> text as changed from clean
"""


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tier(with_relevance(document_items(spark, sf_dir)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored once and written: what follows reads it as often as it needs, under a small plan."""
    return snapshot(spark, sf_dir, "scored", scored_items)


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda c: F.array_join(c, "|").alias(c)
    return scored_items(spark, sf_dir).select("doc_id", "ai_is_related", "ai_score", "ai_label", "ai_relevance_reason", names("ai_signals"), names("ai_noise"), "source_tier", "source_tier_rank")


def _any(text: str, words: list[str]) -> str:
    return f"len(list_filter({words}, lambda k: contains({text}, k))) > 0"


def _bounded(text: str, words: list[str]) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])')"


def _meaningful(text: str) -> str:
    return f"({_bounded(text, [*v.MEANINGFUL_SIGNALS, 'cursor'])} or {_any(text, [k for k in v.AI_KEYWORDS if k not in v.BROAD_AI_TERMS])})"


def _broad(text: str) -> str:
    return f"({_any(text, v.BROAD_AI_TERMS)} or {_bounded(text, v.BROAD_SIGNALS)})"


_TOPIC = "case " + " ".join(f"when {_any('x', words)} then '{label}'" for label, words in v.LABEL_KEYWORDS.items()) + " when len(tech) > 0 then 'ai_tech' else 'ai_general' end"
_CASE = lambda table, default: "case site_id " + " ".join(f"when '{k}' then {x!r}" for k, x in table.items()) + f" else {default!r} end"
SCORED_SQL = f"""
{ITEMS_SQL}, words as (
  select *, lower(title || ' ' || source || ' ' || source || ' news.example') as x, lower(title) as h, {_CASE(v.SOURCE_PRIORS, 0.0)} as prior from items
), signs as (
  select *, list_sort(list_distinct(list_concat(list_filter({v.AI_KEYWORDS}, lambda k: contains(x, k)), case when {_bounded('x', ['cursor'])} then ['cursor'] else [] end))) as ai,
         list_sort(list_filter({v.TECH_KEYWORDS}, lambda k: contains(x, k))) as tech,
         list_concat(list_sort(list_filter({v.NOISE_KEYWORDS}, lambda k: contains(x, k))), list_sort(list_filter({v.COMMERCE_NOISE_KEYWORDS}, lambda k: contains(x, k)))) as noise,
         {_meaningful('x')} as has_ai, {_broad('x')} as is_broad, {_meaningful('h')} as head_ai, {_broad('h')} as head_broad, {_any('h', v.RESEARCH_TERMS)} as head_research,
         {_any('h', v.BUSINESS_TERMS)} as head_business
  from words
), branches as (
  select *, case when site_id = 'curated_media' and not (head_ai or (head_broad and len(tech) > 0)) then 'scope'
                 when site_id = 'curated_media' then 'curated' when site_id = 'aibase' then 'default'
                 when not (has_ai or (is_broad and len(tech) > 0)) then 'missing' else 'kept' end as b
  from signs
), raw as (
  select *, case b when 'scope' then prior + (case when head_broad then 0.28 else 0.0 end)
                   when 'curated' then prior + 0.5 + least(0.12, 0.03 * len(ai)) + least(0.08, 0.02 * len(tech)) - (case when head_ai then 0.0 else least(0.16, 0.04 * len(noise)) end)
                   when 'default' then greatest(0.65, prior + 0.72)
                   when 'missing' then prior + (case when is_broad then 0.32 else 0.0 end) + (case when len(tech) > 0 then 0.08 else 0.0 end)
                   else greatest(0.65, prior + (case when has_ai then 0.52 else 0.34 end) + least(0.18, 0.04 * len(ai)) + least(0.12, 0.03 * len(tech)) - least(0.18, 0.04 * len(noise))) end as s
  from branches
), scored as (
  select *, cast(round(cast(greatest(0, least(1, s)) as double), 2) as double) as ai_score, b in ('default', 'kept') or (b = 'curated' and s >= 0.65) as ai_is_related,
         case when b = 'scope' then 'source_scope_drop' when b = 'curated' and head_research then 'research_paper' when b = 'curated' and head_business then 'industry_business'
              when b = 'missing' then 'not_ai' else {_TOPIC} end as ai_label,
         case b when 'scope' then 'curated_media_requires_ai_title_or_trusted_ai_feed' when 'curated' then 'curated_media_source_filter' when 'default' then 'trusted_ai_source_default_keep'
                when 'missing' then 'missing_meaningful_ai_signal' else case when has_ai then 'matched_ai_signal' else 'matched_broad_ai_plus_tech_signal' end end as ai_relevance_reason,
         case when b = 'default' then case when len(ai) > 0 then ai else [site_id] end else list_concat(ai, tech) end as signals,
         {_CASE({s: t for s, (t, _) in v.SITE_TIERS.items()}, 'other')} as source_tier, {_CASE({s: r for s, (_, r) in v.SITE_TIERS.items()}, 9)} as source_tier_rank
  from raw
)"""
RELEVANCE_SQL = f"""
with {SCORED_SQL}
select doc_id, ai_is_related, ai_score, ai_label, ai_relevance_reason, array_to_string(signals, '|') as ai_signals, array_to_string(noise, '|') as ai_noise,
       source_tier, cast(source_tier_rank as integer) as source_tier_rank
from scored
"""


def item_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_items(spark, sf_dir).select("doc_id", importance(NOW).alias("score"))


_TIER_WEIGHT = "case source_tier " + " ".join(f"when '{k}' then {x}" for k, x in v.TIER_IMPORTANCE.items()) + " end"


def _importance(copies: str) -> str:
    editorial = "case when site_id = 'official_ai' then 0.9 when ai_is_related then greatest(0.45, ai_score * 0.72) else ai_score * 0.6 end"
    return (
        f"round(cast(0.3 as double) * ({editorial}) + cast(0.22 as double) * {_TIER_WEIGHT} + cast(0.2 as double) * ai_score "
        f"+ cast(0.18 as double) * pow(cast(0.5 as double), greatest(0, {NOW_S} - at_s) / 3600.0 / 48) + cast(0.1 as double) * least(1.0, ({copies} - 1) / 4.0), 4)"
    )


ITEM_IMPORTANCE_SQL = f"with {SCORED_SQL} select doc_id, cast({_importance('1')} as double) as score from scored"


def creator_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    metrics = F.struct(F.floor(F.abs("value")).alias("likes"), (F.col("user_id") % 50).alias("comments"), F.coalesce(k, F.lit(0)).alias("collects"), F.lit(1).alias("shares"))
    items = events.select(
        "event_id", F.element_at(F.array(*map(F.lit, v.CREATOR_SITES)), (F.col("event_id") % 2 + 1).cast("int")).alias("site_id"), metrics.alias("creator_metrics"),
        F.timestamp_micros(F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))).alias("published_at"), F.lit(None).cast("timestamp").alias("first_seen_at"),
    )
    return with_creator_ranking(items, NOW).select("event_id", "site_id", "creator_engagement_total", "creator_heat_score", "creator_freshness_bonus", "creator_hot_score")


CREATOR_RANKING_SQL = f"""
with m as (
  select event_id, list_extract({v.CREATOR_SITES}, cast(event_id % 2 + 1 as integer)) as site_id,
         cast(floor(abs(value)) + 2.0 * (user_id % 50) + 1.5 * coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) + 2.0 as double) as e,
         ({NOW_S} - epoch(ts)) / 3600.0 as age
  from events
), h as (
  select *, least(100.0, (case when site_id = 'tikhub_xiaohongshu' then 22.0 else 20.0 end) * log10(1.0 + e)) as heat, case when age between 0 and 24 then 15.0 else 0.0 end as bonus from m
)
select event_id, site_id, round(e, 1) as creator_engagement_total, round(cast(heat as double), 1) as creator_heat_score, cast(bonus as double) as creator_freshness_bonus,
       round(cast(least(100.0, heat * cast(0.85 as double) + bonus) as double), 1) as creator_hot_score
from h
"""


def archive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an archive, line items as a batch of which many hit one id.

    A third of the archive's ids and a quarter of the batch's are shifted, so
    that some ids are in either alone.
    """
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    site = F.when(F.col("k") % 2 == 0, F.lit("opmlrss")).otherwise(F.lit("zeli"))
    at = lambda n: F.timestamp_seconds(F.lit(START_S) + n)
    shifted = lambda key, n, by: F.when(key % n == 0, key + by).otherwise(key).alias("k")
    old = orders.select(shifted(F.col("o_orderkey"), 3, 10**12)).select(
        F.col("k").cast("string").alias("id"), site.alias("site_id"), F.lit("old").alias("site_name"), F.lit("old").alias("source"), F.lit("old").alias("title"), F.lit("http://o/").alias("url"),
        F.when(F.col("k") % 5 > 0, at(F.col("k") % 1000)).alias("published_at"), at(F.lit(0)).alias("first_seen_at"), at(F.lit(1)).alias("last_seen_at"),
    )
    batch = lines.select(shifted(F.col("l_orderkey"), 4, 2 * 10**12), F.col("l_linenumber").alias("pos")).select(
        F.col("k").cast("string").alias("id"), site.alias("site_id"), F.lit("new").alias("site_name"), F.concat(F.lit("s"), F.col("pos")).alias("source"), F.concat(F.lit("t"), F.col("pos")).alias("title"),
        F.lit("http://n/").alias("url"), F.when(F.col("pos") % 3 > 0, at(2000 + F.col("pos"))).alias("published_at"), "pos",
    )
    out = archive.retained(archive.upserted(old, batch, NOW), NOW, days=21)
    return out.select("id", "site_id", "source", "title", "url", _micros("published_at").alias("published"), _micros("first_seen_at").alias("first_seen"), _micros("last_seen_at").alias("last_seen"))


ARCHIVE_UPSERT_SQL = f"""
with old as (
  select k, case when k % 5 > 0 then {START_S} + k % 1000 end as p from (select o_orderkey + case when o_orderkey % 3 = 0 then 1000000000000 else 0 end as k from orders)
), batch as (
  select l_orderkey + case when l_orderkey % 4 = 0 then 2000000000000 else 0 end as k, max(l_linenumber) as last, min(case when l_linenumber % 3 > 0 then l_linenumber end) as a, max(case when l_linenumber % 3 > 0 then l_linenumber end) as b
  from lineitem group by 1
), both_ as (
  select coalesce(old.k, batch.k) as k, old.k is not null as was, old.p, batch.last, {START_S} + 2000 + batch.a as a, {START_S} + 2000 + batch.b as b
  from old full join batch on old.k = batch.k
)
select cast(k as varchar) as id, case when k % 2 = 0 then 'opmlrss' else 'zeli' end as site_id,
       case when last is null then 'old' else 's' || cast(last as varchar) end as source, case when last is null then 'old' else 't' || cast(last as varchar) end as title,
       case when last is null then 'http://o/' else 'http://n/' end as url,
       cast(case when last is not null and k % 2 = 0 then coalesce(b, p) else coalesce(p, a) end as bigint) * 1000000 as published,
       cast(case when was then {START_S} else {NOW_S} end as bigint) * 1000000 as first_seen, cast(case when last is null then {START_S} + 1 else {NOW_S} end as bigint) * 1000000 as last_seen
from both_
"""


def window_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = archive.in_window(scored_items(spark, sf_dir), NOW, hours=12)
    return items.agg(F.count("*").alias("raw"), F.count_if(F.col("ai_score") >= v.BROAD_SCORE).alias("broad"), F.count_if("ai_is_related").alias("related"))


WINDOW_POOLS_SQL = f"""
with {SCORED_SQL}
select count(*) as raw, coalesce(count_if(ai_score >= 0.3), 0) as broad, coalesce(count_if(ai_is_related), 0) as related from scored where at_s >= {NOW_S} - 43200
"""


def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.distinct_items(document_items(spark, sf_dir)).select("id", "site_id", "title")


_RANK = _CASE({s: r for s, (_, r) in v.SITE_TIERS.items()}, 9)
DISTINCT_DOCUMENTS_SQL = f"""
with {ITEMS_SQL}
select id, site_id, title from (
  select *, row_number() over (partition by lower(title), url order by {_RANK}, at_s desc, title, id) as k
  from (select id, site_id, trim(title, chr(32) || chr(9) || chr(10) || chr(13)) as t, title, url, at_s from items)) where k = 1
"""


def site_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.site_statistics(scored_items(spark, sf_dir), F.col("ai_is_related"))


SITE_STATISTICS_SQL = f"""
with {SCORED_SQL}
select site_id, count(*) as raw_count, count_if(ai_is_related) as kept_count, round(cast(count_if(ai_is_related) as double) * 100.0 / count(*), 1) as kept_percent from scored group by site_id
"""


def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    items = scored_items(spark, sf_dir).join(truth, "doc_id", "left")
    out = audit.source_audit(items, F.col("ai_is_related"), F.col("quality") == 1, F.col("ai_score"))
    return out.withColumn("mean_score", F.round("mean_score", 4))


SOURCE_AUDIT_SQL = f"""
with {SCORED_SQL}, t as (select doc_id, max(quality) as quality from labels group by doc_id), a as (
  select source, count(*) as total, count_if(ai_is_related) as kept, count_if(quality = 1) as hits, count_if(ai_is_related and coalesce(quality, 0) <> 1) as noise, round(avg(ai_score), 4) as mean_score
  from scored left join t using (doc_id) group by source
)
select *, case when total >= 20 and kept / total < 0.05 then 'delete' when total >= 20 and kept / total < 0.3 then 'throttle' else 'keep' end as action from a
"""


def scoring_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, label = scored_items(spark, sf_dir), F.col("ai_label")
    stricter = (F.col("ai_is_related") & (F.col("ai_score") >= 0.7)) | (F.size("ai_signals") >= 3)
    return audit.scoring_changes(items, F.col("source"), (F.col("ai_is_related"), label), (stricter, F.when(F.col("source_tier") == "official", "official").otherwise(label)))


SCORING_CHANGES_SQL = f"""
with {SCORED_SQL}, c as (
  select source as key, ai_is_related as x, (ai_is_related and ai_score >= 0.7) or len(signals) >= 3 as y, ai_label as m, case when source_tier = 'official' then 'official' else ai_label end as n from scored
)
select key, count(*) as total, count_if(x) as kept_before, count_if(y) as kept_after, count_if(x and not y) as dropped, count_if(not x and y) as added, count_if(x and y and m <> n) as moved from c group by key
"""


def spark_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return audit.spark_line(events, "event_type", F.col("at"), F.lit(NOW))


SPARK_LINE_SQL = f"""
with seen as (
  select event_type, cast(11 - floor(({NOW_S} - epoch(ts)) / 3600.0 * 12 / 24) as integer) as bucket, count(*) as n
  from events where epoch(ts) <= {NOW_S} and epoch(ts) > {NOW_S - 86400} group by 1, 2
), grid as (select distinct event_type, cast(unnest(range(12)) as integer) as bucket from events)
select event_type, bucket, coalesce(n, 0) as n from grid left join seen using (event_type, bucket)
"""


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.section_counts(scored_items(spark, sf_dir), F.col("ai_label"))


SECTION_COUNTS_SQL = f"with {SCORED_SQL} select coalesce(ai_label, 'all') as section, count(*) as n from scored group by rollup (ai_label)"


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.story_records(stories.by_article(_scored(spark, sf_dir)), NOW)


def story_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stories(spark, sf_dir)
    return out.select("story_key", "primary_id", "item_count", "score", "category", F.array_join("reasons", "|").alias("reasons"), F.array_join("source_names", "|").alias("source_names"))


STORIES_SQL = f"""
{SCORED_SQL}, counted as (select *, count(*) over (partition by url) as n from scored), ranked as (
  select *, cast({_importance('n')} as double) as score from counted
), firsts as (
  select *, row_number() over (partition by url order by source_tier_rank, score desc, at_s desc, title, id) as k, list_sort(list_distinct(list(source) over (partition by url))) as names,
         max(at_s) over (partition by url) as latest from ranked
), stories as (
  select url as story_key, id as primary_id, title, n as item_count, score, latest, names,
         case when source_tier = 'official' then 'official' when n >= 3 then 'multi_source' when score >= 0.72 then 'industry' else 'watch' end as category,
         list_filter([case when source_tier_rank = 0 then 'official_source' end, case when n >= 2 then 'multi_source' end, case when ai_score >= 0.8 then 'high_ai_relevance' end,
                      case when score >= 0.75 then 'high_importance' end], lambda x: x is not null) as reasons
  from firsts where k = 1
)"""
STORY_RECORDS_SQL = f"""
with {STORIES_SQL}
select story_key, primary_id, item_count, score, category, case when len(reasons) > 0 then array_to_string(reasons, '|') else 'recent_ai_signal' end as reasons, array_to_string(names, '|') as source_names
from stories
"""


def daily_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = stories.passing_brief(_stories(spark, sf_dir)).orderBy(F.desc("score"), "latest_at", "title", "story_key").limit(20)
    return best.select("story_key", "score", "item_count", "category")


DAILY_BRIEF_SQL = f"""
with {STORIES_SQL}
select story_key, score, item_count, category from stories where item_count >= 2 or score >= 0.72 order by score desc, latest, title, story_key limit 20
"""


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent, so no SQL: tests hold it against a plain loop."""
    return dedup.without_near_duplicates(_scored(spark, sf_dir)).select("id", "site_id", "title")


def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir)
    return overlap.classified(items.where("site_id = 'hackernews'"), items).select("id", "match", "best_id", "similarity")


SOURCE_OVERLAP_SQL = rf"""
with {ITEMS_SQL}, t as (
  select id, site_id, url, lower(title) as low, list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(title), 'https?://\S+', ' ', 'g'), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]{{2,}}'),
         lambda x: length(x) >= 2 and not list_contains({v.TITLE_STOPWORDS}, x))) as w from items
), p as (
  select a.id, b.id as best_id, case when a.url = b.url then 1 when a.low = b.low and a.low <> '' then 2 else 3 end as kind,
         len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as j
  from t a join t b on a.site_id = 'hackernews' and b.site_id <> 'hackernews'
), best as (
  select *, row_number() over (partition by id order by kind, case when kind = 3 then -j else 0 end, best_id) as k from p where kind < 3 or j >= 0.88
)
select id, list_extract(['url_exact', 'title_exact', 'title_similarity'], kind) as match, best_id, case when kind < 3 then 1.0 else round(j, 3) end as similarity from best where k = 1
"""


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _scored(spark, sf_dir)
    sites = items.groupBy("site_id").agg((F.count_if("ai_is_related") > 0).alias("ok"))
    out = govern.gate(items, sites, stories.passing_brief(_stories(spark, sf_dir)), NOW)
    return out.withColumn("value", F.round("value", 4))


QUALITY_GATE_SQL = f"""
with {STORIES_SQL}, s as (select site_id, count_if(ai_is_related) > 0 as ok from scored group by site_id), one as (
  select ({NOW_S} - max(at_s)) / 3600.0 as age, count(*) as n, count_if(trim(title) = '') as bad,
         (select count(*) from s) as sites, (select avg(cast(ok as integer)) from s) as success, (select count(*) from stories where item_count >= 2 or score >= 0.72) as brief
  from scored
)
select 'fresh' as rule, age <= 36 as ok, round(cast(age as double), 4) as value from one union all select 'adapters', sites >= 5, sites from one
union all select 'success', success >= 0.7, round(success, 4) from one union all select 'brief', brief >= 5, brief from one
union all select 'latest', n >= 20, n from one union all select 'shape', bad = 0, bad from one
"""


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return govern.leaks(docs, ["text", "source"])


LEAKS_SQL = f"""
select doc_id as id, 'text' as field from documents where regexp_matches(text, '{v.EMAIL_PATTERN}') or regexp_matches(text, '{_RE2_SECRET}', 'i')
union all select doc_id, 'source' from documents where regexp_matches(source, '{v.EMAIL_PATTERN}') or regexp_matches(source, '{_RE2_SECRET}', 'i')
"""


def reader_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader's text says in short, of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", reader_context(F.col("text")).alias("context"))


_BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
READER_CONTEXTS_SQL = rf"""
with a as (
  select doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')) as ls from documents
), b as (
  select doc_id, list_filter(ls, lambda x: starts_with(lower(x), 'title:'))[1:1] as title,
         list_filter(ls[1:40], lambda x: not regexp_matches(lower(x), '^(title:|url source:|markdown content:)') and length(trim(regexp_replace(regexp_replace(
           regexp_replace(regexp_replace(x, '!?\[[^\]]*\]\([^)]*\)', '', 'g'), '^[*+-]{_BLANK}+|^\p{{Nd}}+\.{_BLANK}+', ''), '[#>*_`|]', ' ', 'g'), '{_BLANK}+', ' ', 'g'))) >= 20) as body from a
)
select doc_id, array_to_string(list_concat(title, body[1:3]), chr(10)) as context from b
"""


def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_context(F.col("html")).alias("context"))


PAGE_CONTEXT_SQL = r"""
with said as (
  select page_id, regexp_extract(html, '(?is)<meta[^>]+name=["'']description["''][^>]*content=["'']([^"'']*)', 1) as d, regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1)[1:3] as ps from pages
)
select page_id, left(array_to_string(list_filter(list_transform(list_concat([d], list_transform(ps, lambda p: regexp_replace(p, '(?s)<[^>]+>', ' ', 'g'))), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: t <> ''), chr(10)), 800) as context
from said
"""


def public_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", snippet(F.coalesce("text", F.lit(""))).alias("snippet"))


PUBLIC_SNIPPETS_SQL = rf"""
with c as (
  select conv_id, turn, regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '{v.EMAIL_PATTERN}', '[redacted-email]', 'g'), '{_RE2_SECRET}', '[redacted-secret]', 'gi') as t from conversations
)
select conv_id, turn, case when length(t) > 240 then rtrim(left(t, 239)) || '…' else t end as snippet from c
"""


def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of each document's title and its successor's."""
    items = document_items(spark, sf_dir).select("doc_id", title_tokens(F.col("title")).alias("w"))
    after = items.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("w2"))
    return items.join(after, "doc_id").select("doc_id", F.round(jaccard(F.col("w"), F.col("w2")), 6).alias("jaccard"))


TITLE_PAIRS_SQL = rf"""
with {ITEMS_SQL}, t as (
  select doc_id, list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(title), 'https?://\S+', ' ', 'g'), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]{{2,}}'),
         lambda x: length(x) >= 2 and not list_contains({v.TITLE_STOPWORDS}, x))) as w from items
)
select a.doc_id, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0.0), 6) as jaccard from t a join t b on b.doc_id = a.doc_id + 1
"""


#: name: (query, SQL or None)
ALL: dict[str, tuple[Query, str | None]] = {
    "top_items": (top_items, TOP_ITEMS_SQL),
    "url_forms": (url_forms, URL_FORMS_SQL),
    "title_words": (title_words, TITLE_WORDS_SQL),
    "title_pairs": (title_pairs, TITLE_PAIRS_SQL),
    "redaction": (redaction, REDACTION_SQL),
    "relevance": (relevance, RELEVANCE_SQL),
    "item_importance": (item_importance, ITEM_IMPORTANCE_SQL),
    "creator_ranking": (creator_ranking, CREATOR_RANKING_SQL),
    "archive_upsert": (archive_upsert, ARCHIVE_UPSERT_SQL),
    "window_pools": (window_pools, WINDOW_POOLS_SQL),
    "distinct_documents": (distinct_documents, DISTINCT_DOCUMENTS_SQL),
    "near_duplicates": (near_duplicates, None),
    "story_records": (story_records, STORY_RECORDS_SQL),
    "daily_brief": (daily_brief, DAILY_BRIEF_SQL),
    "source_overlap": (source_overlap, SOURCE_OVERLAP_SQL),
    "site_statistics": (site_statistics, SITE_STATISTICS_SQL),
    "source_audit": (source_audit, SOURCE_AUDIT_SQL),
    "scoring_changes": (scoring_changes, SCORING_CHANGES_SQL),
    "spark_line": (spark_line, SPARK_LINE_SQL),
    "section_counts": (section_counts, SECTION_COUNTS_SQL),
    "quality_gate": (quality_gate, QUALITY_GATE_SQL),
    "leaks": (leaks, LEAKS_SQL),
    "page_context": (page_context, PAGE_CONTEXT_SQL),
    "reader_contexts": (reader_contexts, READER_CONTEXTS_SQL),
    "public_snippets": (public_snippets, PUBLIC_SNIPPETS_SQL),
}
