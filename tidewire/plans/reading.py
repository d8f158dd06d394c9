"""The read side's queries over the given tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import reading as r
from ..functions.scores import site_rank
from ..operators import audit, reading, status, stories
from ..operators.graph import written
from .items import NOW, NOW_S, snapshot, table
from .queries import SCORED_SQL, STORIES_SQL, Query, _scored

MIX = ["aihot", "socialdata_x", "hackernews", "tikhub_douyin", "zeli", "newsnow", "waytoagi"]
NAMES = ["AI HOT", "X", "Hacker News", "TikHub Douyin", "Zeli", "NewsNow", "WaytoAGI"]


def _viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that lists are read from, derived once and written."""
    return snapshot(spark, sf_dir, "viewed", lambda *_: reading.viewed(reading.safe(_scored(spark, sf_dir)), NOW))


def _pct(x: str) -> str:
    return f"(case when {x} is null or {x} <= 0 then 0 when {x} <= 1 then cast(floor({x} * 100 + 0.5) as integer) else cast(floor({x} + 0.5) as integer) end)"


def _case(table_: dict, column: str, default: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{x}'" for k, x in table_.items()) + f" else {default} end"


_EVENT_TEXT = f"regexp_replace(regexp_replace(regexp_replace(lower({{t}}), 'https?://\\S+', '', 'g'), '[\\s　]+', '', 'g'), '{r.EVENT_PUNCTUATION}', '', 'g')"


def _event_key(t: str) -> str:
    book, plain = f"regexp_extract({t}, '《([^》]{{4,40}})》', 1)", _EVENT_TEXT.format(t=t)
    model = f"regexp_extract({plain}, '{r.MODEL_KEYS}', 1)"
    return f"case when {book} <> '' then 'book:' || left({_EVENT_TEXT.format(t=book)}, 36) when {model} <> '' then 'entity:' || {model} else 'title:' || left({plain}, 34) end"


_GROUP = (
    f"case when {{site}} in ('tikhub_douyin', 'tikhub_xiaohongshu') or regexp_matches(lower({{source}} || ' ' || {{name}}), '{'|'.join(r.CREATOR_SOURCE_WORDS)}') then 'creator' "
    f"when list_contains({r.COMMUNITY_SITES}, {{site}}) or regexp_matches(lower({{source}} || ' ' || {{name}}), '{'|'.join(r.COMMUNITY_SOURCE_WORDS)}') then 'community' else 'other' end"
)
_SECTION = (
    "case when grp <> 'other' then grp "
    + " ".join(f"when ai_label = '{k}' then '{x}'" for k, x in r.LABEL_SECTIONS.items())
    + " "
    + " ".join(f"when regexp_matches(hay, '{words}') then '{name}'" for name, words in r.SECTION_WORDS.items())
    + " else 'all' end"
)
_TYPE = (
    "case when {site} = 'official_ai' or {tier} = 'official' then 'official' "
    + " ".join(f"when list_contains({sites}, {{site}}){' or {tier} = ' + chr(39) + 'user_opml' + chr(39) if name == 'rss' else ''} then '{name}'" for name, sites in r.TYPE_SITES.items())
    + " else 'aggregate' end"
)
_SIGNAL = (
    "case when {name} = 'AI HOT' then 'AI HOT精选' when regexp_matches(lower({name} || ' ' || {source}), 'hackernews|hacker news') then 'HN热议' when contains(lower({name} || ' ' || {source}), 'github') then 'GitHub趋势' "
    "when {name} = 'Official AI Updates' then '官方更新' when {name} = 'Follow Builders' then 'Builders' when contains(lower({name} || ' ' || {source}), 'tikhub douyin') then '抖音自媒体' "
    "when contains(lower({name} || ' ' || {source}), 'tikhub xiaohongshu') then '小红书自媒体' when {name} = 'AIbase' then 'AIbase' when {name} = 'OPML RSS' then 'OPML' when {name} <> '' then {name} else '来源' end"
)
_d = lambda x: f"cast({x} as double)"
SEEN_SQL = f"""
{SCORED_SQL}, seen0 as (
  select *, {_pct('ai_score')} as score_pct, {_GROUP.format(site='site_id', source='source', name='source')} as grp, {_TYPE.format(site='site_id', tier='source_tier')} as source_type,
         {_SIGNAL.format(name='source', source='source')} as signal, site_id in ('official_ai', 'aihot') or source_tier in ('official', 'curated') as curated, {_event_key('title')} as event,
         lower(concat_ws(' ', nullif(title, ''), nullif(source, ''), nullif(source, ''), site_id, ai_label, nullif(array_to_string(signals, ' '), ''))) as hay
  from scored
), seen1 as (
  select *, {_SECTION} as section, case when site_id = 'official_ai' then 90 when score_pct > 0 then greatest(45, cast(floor(score_pct * {_d(0.72)} + 0.5) as integer)) else 36 end as p_editorial,
         case when site_id = 'official_ai' then 100 else greatest(28, least(86, 86 - source_tier_rank * 9)) end as p_tier,
         case when at_s > {NOW_S} then 100 else cast(floor(pow({_d(0.5)}, ({NOW_S} - at_s) / 3600.0 / 48) * 100 + 0.5) as integer) end as p_fresh, least(100, len(signals) * 18) as p_signals
  from seen0
), seen2 as (
  select *, cast(floor(p_editorial * {_d(0.3)} + p_tier * {_d(0.22)} + score_pct * {_d(0.2)} + p_fresh * {_d(0.18)} + p_signals * {_d(0.1)} + 0.5) as integer) as priority from seen1
), seen as (
  select *, score_pct >= 75 or priority >= 82 or site_id in ('official_ai', 'aihot') as high, case when priority >= 92 then 'A+' when priority >= 82 then 'A' when priority >= 70 then 'B' else 'C' end as grade from seen2
)"""


def item_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section, source type, signal, scores, priority and grade of every item."""
    return _viewed(spark, sf_dir).select("doc_id", F.col("group").alias("source_group"), "section", "source_type", "signal", "curated", "score_pct", "priority", "high", "grade", "event")


ITEM_VIEW_SQL = f"with {SEEN_SQL} select doc_id, grp as source_group, section, source_type, signal, curated, score_pct, priority, high, grade, event from seen"


def source_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels, authors, groups, types and signals of sources of every form."""
    n = F.col("page_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    handle = F.concat(F.lit("@h"), (n % 13).cast("string"))
    forms = [F.concat(F.lit("X：Name ("), handle, F.lit(")")), F.lit("某公众号"), F.lit("Hacker News 热"), F.lit("Blog（RSS）"), handle, F.lit("GitHub · Trending Today"), F.lit(""), F.lit("36氪")]
    rows = table(spark, sf_dir, "pages").select("page_id", pick(MIX, n).alias("site"), pick(NAMES, n).alias("name"), F.element_at(F.array(*forms), (F.floor(n / len(MIX)) % len(forms) + 1).cast("int")).alias("source"))
    site, source, name = F.col("site"), F.col("source"), F.col("name")
    signal = r.source_signal(name, source)
    return rows.select("page_id", r.channel(site, source).alias("channel"), r.author(site, source).alias("author"), r.author_display(site, source).alias("display"), r.source_group(site, source, name).alias("source_group"), r.source_type(site, F.lit("x")).alias("source_type"), signal.alias("signal"), r.source_priority(signal).alias("signal_priority"))


SOURCE_FORMS_SQL = f"""
with rows_ as (
  select page_id, list_extract({MIX}, cast(page_id % {len(MIX)} + 1 as integer)) as site, list_extract({NAMES}, cast(page_id % {len(MIX)} + 1 as integer)) as name, '@h' || cast(page_id % 13 as varchar) as h,
         cast(floor(page_id / {len(MIX)}) as bigint) % 8 as f from pages
), named as (
  select *, case f when 0 then 'X：Name (' || h || ')' when 1 then '某公众号' when 2 then 'Hacker News 热' when 3 then 'Blog（RSS）' when 4 then h when 5 then 'GitHub · Trending Today' when 6 then '' else '36氪' end as source from rows_
), via as (
  select *, case when site = 'aihot' then case f when 0 then 'x' when 1 then 'wechat' when 2 then 'hn' when 3 then 'rss' end end as channel, {_SIGNAL.format(name='name', source='source')} as signal from named
)
select page_id, channel, case when (site = 'socialdata_x' or channel = 'x') and f in (0, 4) then h end as author,
       case when site = 'socialdata_x' then nullif(source, '') when channel = 'x' then 'Name (' || h || ')' end as display,
       case when channel = 'wechat' then 'creator' when channel = 'hn' then 'community' else {_GROUP.format(site='site', source='source', name='name')} end as source_group,
       {_TYPE.format(site='site', tier="'x'")} as source_type, signal, cast({_case({k: v for k, v in r.SIGNAL_PRIORITY.items()}, 'signal', f"'{r.OTHER_PRIORITY}'")} as integer) as signal_priority
from via
"""


def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of 60 in each of the four orders."""
    items = _viewed(spark, sf_dir)
    out = [reading.page(items, order).select(F.lit(order).alias("list_order"), "place", "doc_id") for order in ("latest", "ai", "source", "priority")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


_ORDERS = {"latest": "at_s desc, priority desc, id", "ai": "score_pct desc, priority desc, at_s desc, id", "source": "n desc, k, priority desc, at_s desc, id", "priority": "priority desc, at_s desc, id"}
ITEM_PAGES_SQL = f"with {SEEN_SQL}, keyed as (select *, signal || ' ' || source || ' ' || source as k, count(*) over (partition by signal || ' ' || source || ' ' || source) as n from seen)\n" + "\nunion all\n".join(
    f"select '{name}' as list_order, cast(place as integer) as place, doc_id from (select doc_id, row_number() over (order by {order}) as place from keyed) where place <= 60" for name, order in _ORDERS.items()
)


def item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by words, section, source type and confirmed events, as days of the first page."""
    items = _viewed(spark, sf_dir)
    found = {
        "words": reading.chosen(items, query="The "), "section": reading.chosen(items, section="community"), "type": reading.chosen(items, source_type="aggregate", level="high"),
        "curated": reading.chosen(items, level="curated"), "multi": reading.chosen(items, level="multi"),
    }
    out = None
    for name, rows in found.items():
        part = reading.days(reading.page(rows, "latest")).select(F.lit(name).alias("filter"), F.date_format("day", "yyyy-MM-dd").alias("day"), "n")
        out = part if out is None else out.union(part)
    return out


_FILTERS = {
    "words": "contains(lower(concat_ws(' ', title, source, source)), 'the')", "section": "section = 'community'", "type": "source_type = 'aggregate' and high", "curated": "curated",
    "multi": "event in (select event from seen group by event having count(distinct signal) > 1)",
}
ITEM_SEARCH_SQL = f"with {SEEN_SQL}\n" + "\nunion all\n".join(
    f"select '{name}' as filter, strftime(make_timestamp((at_s + 28800) * 1000000), '%Y-%m-%d') as day, count(*) as n from (select at_s from seen where {test} order by at_s desc, priority desc, id limit 60) group by 2" for name, test in _FILTERS.items()
)


def section_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.section_view(_viewed(spark, sf_dir))


SECTION_VIEW_SQL = f"""
with {SEEN_SQL}, one as (select section, high, source from seen union all select 'all', high, source from seen where section <> 'all')
select section, count(*) as n, count_if(high) as high, count(distinct source) as sources from one group by section
"""

def section_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section that items belong to, with the stories that have one there; stories are items of one URL."""
    inverted = written(reading.by_section(_viewed(spark, sf_dir)))
    members = inverted.where("section = 'hot'").select(F.col("url").alias("story_id"), "id", "url")
    return reading.section_stories(inverted, members)


_IN = lambda s: f"coalesce(list_contains({[k for k, x in r.LABEL_SECTIONS.items() if x == s]}, ai_label), false)"
_OF = lambda g: f"list_contains({r.GROUP_SITES[g]}, site_id) or regexp_matches(lower(source || ' ' || source), '{r.GROUP_SOURCE_WORDS[g]}')"
_SECTION_TESTS = {
    "models": f"regexp_matches(content, '{r.SECTION_WORDS['models']}') or ({_IN('models')} and not regexp_matches(hay, '{r.TOOL_WORDS}'))",
    **{s: f"{_IN(s)} or regexp_matches(hay, '{r.SECTION_WORDS[s]}')" for s in ("products", "devtools", "industry", "research")},
    "hn": _OF("hn"), "creator": _OF("creator"), "community": f"{_OF('community')} or regexp_matches(hay, '{r.COMMUNITY_WORDS}')",
}
def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, tags, concerned readers and day of every item, as the list of models shows them."""
    rows = reading.labelled(_viewed(spark, sf_dir), NOW, active="models")
    return rows.select("doc_id", *(F.array_join(c, "|").alias(c) for c in ("sections", "tags", "impacts")), "day", "weekday")


_SECTIONS = f"list_filter([{', '.join(f"case when {t} then '{s}' end" for s, t in _SECTION_TESTS.items())}], lambda x: x is not null)"
_LABELS = lambda pairs: f"list_filter([{', '.join(f"case when {t} then '{x}' end" for x, t in pairs)}], lambda x: x is not null)"
_HAS = lambda s: f"list_contains(sections, '{s}')"
# Of labels that two tests give, the tests are one.
ITEM_LABELS_SQL = f"""
with {SEEN_SQL}, c as (
  select *, lower(concat_ws(' ', nullif(title, ''), nullif(source, ''), nullif(source, ''), site_id, nullif(array_to_string(signals, ' '), ''))) as content,
         count(*) over (partition by event) > 1 as confirmed, make_timestamp(cast(at_s as bigint) * 1000000) + interval 8 hours as local_t from seen
), l as (
  select *, case when len(found) > 0 then found else ['industry'] end as sections from (select *, {_SECTIONS} as found from c)
), m as (
  select *, {_LABELS([(x, _HAS(s) + (" or " + _HAS('hn') if s == 'community' else '')) for s, x in r.IMPACTS.items() if s != 'hn'])} as impact,
         {_LABELS([('模型', 'true'), (r.MANY_SOURCES, 'confirmed'), *((x, f"site_id = '{s}'") for s, x in r.SITE_TAGS.items()), *((x, _HAS(s)) for s, x in r.SECTION_TAGS.items())])} as tag from l
)
select doc_id, array_to_string(sections, '|') as sections, array_to_string(tag[1:3], '|') as tags, case when len(impact) > 0 then array_to_string(impact[1:3], '|') else '{r.NO_IMPACT}' end as impacts,
       case when year(local_t) = year(make_timestamp(cast({NOW_S} as bigint) * 1000000) + interval 8 hours) then '' else year(local_t) || '年' end || month(local_t) || '月' || day(local_t) || '日' as day, list_extract({r.WEEKDAYS}, cast(dayofweek(local_t) + 1 as integer)) as weekday
from m
"""


SECTION_STORIES_SQL = f"""
with {SEEN_SQL}, c as (select *, lower(concat_ws(' ', nullif(title, ''), nullif(source, ''), nullif(source, ''), site_id, nullif(array_to_string(signals, ' '), ''))) as content from seen), l as (
  select id, url, source, high, list_filter([{', '.join(f"case when {t} then '{s}' end" for s, t in _SECTION_TESTS.items())}], lambda x: x is not null) as s from c
), e as (select id, url, source, high, unnest(list_concat(['hot'], case when len(s) > 0 then s else ['industry'] end)) as section from l)
select section, count(*) as items, count_if(high) as high, count(distinct source) as sources, count(distinct url) as stories from e group by section
"""

_CLUSTERS_SQL = f"""
{SEEN_SQL}, signed as (select *, cast({_case(r.SIGNAL_PRIORITY, 'signal', f"'{r.OTHER_PRIORITY}'")} as integer) as weight from seen where score_pct > 0), firsts as (
  select *, row_number() over (partition by event order by weight desc, score_pct desc, at_s desc, id) as k, count(*) over (partition by event) as members, max(score_pct) over (partition by event) as top,
         list_sort(list_distinct(list(signal) over (partition by event))) as signals_ from signed
), clusters as (
  select event, id as main_id, priority, at_s, signals_, members, len(signals_) as sources,
         least(100, top + least(12, (len(signals_) - 1) * 6) + case when list_contains(signals_, 'AI HOT精选') then 8 when list_contains(signals_, 'HN热议') or list_contains(signals_, 'GitHub趋势') then 6 when list_contains(signals_, '官方更新') then 5 else 0 end) as score
  from firsts where k = 1
)"""


def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reading.event_clusters(_viewed(spark, sf_dir))
    return out.select("event", F.col("main.id").alias("main_id"), F.array_join("signals", "|").alias("signals"), "members", "score")


EVENT_CLUSTERS_SQL = f"with {_CLUSTERS_SQL} select event, main_id, array_to_string(signals_, '|') as signals, members, cast(score as integer) as score from clusters"


def event_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading events and the three headlines."""
    clusters = reading.event_clusters(_viewed(spark, sf_dir))
    lead = reading.picked_events(clusters).select(F.lit("lead").alias("board"), "event", F.col("score").cast("int").alias("score"))
    return lead.union(reading.headlines(clusters).select(F.lit("headline"), "event", F.col("headline").cast("int")))


EVENT_BOARDS_SQL = f"""
with {_CLUSTERS_SQL}
select 'lead' as board, event, cast(score as integer) as score from (select * from clusters order by sources desc, score desc, at_s desc, main_id limit 8)
union all
select 'headline', event, cast(h as integer) from (select *, least(100, priority + least(18, (sources - 1) * 9) + least(8, (members - 1) * 4)) as h from clusters order by h desc, at_s desc, main_id limit 3)
"""


def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.source_groups(_viewed(spark, sf_dir))


_GROUPS_SQL = f"""
{SEEN_SQL}, one as (
  select site_id, source, coalesce(nullif({_EVENT_TEXT.format(t='title')}, ''), regexp_extract(url, '^[a-z]+://[^?#]*')) as key, max(priority) as priority, count(*) as raw from seen group by 1, 2, 3
), best as (select *, row_number() over (partition by site_id, source order by priority desc, key) as n from one)"""
SOURCE_GROUPS_SQL = f"""
with {_GROUPS_SQL}
select site_id, source, cast(sum(raw) as bigint) as raw, count(*) as shown, cast(floor(avg(case when n <= 3 then priority end) + 0.5) as integer) as value from best group by site_id, source
"""


def site_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.site_groups(reading.source_groups(_viewed(spark, sf_dir)))


SITE_GROUPS_SQL = f"""
with {_GROUPS_SQL}, by_site as (select site_id, count(distinct source) as sources, cast(sum(raw) as bigint) as raw, count(*) as shown from best group by site_id)
select *, cast(row_number() over (order by shown desc, site_id) as integer) as place from by_site
"""


def leading_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 items, the first 20 of a label and the first 20 with a word."""
    items = _scored(spark, sf_dir)
    out = None
    for name, most, label, word in (("top", 30, None, None), ("label", 20, "ai_general", None), ("word", 20, None, "THE")):
        part = reading.leading(items, most, label, word).select(F.lit(name).alias("list"), "doc_id", "ai_score")
        out = part if out is None else out.union(part)
    return out


LEADING_LISTS_SQL = f"with {SCORED_SQL}\n" + "\nunion all\n".join(
    f"select '{name}' as list, doc_id, ai_score from (select * from scored where ai_is_related and {test} order by source_tier_rank, ai_score desc, id limit {most})"
    for name, most, test in (("top", 30, "true"), ("label", 20, "ai_label = 'ai_general'"), ("word", 20, "contains(lower(concat_ws(' ', title, array_to_string(signals, ' '))), 'the')"))
)


def _story_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stories by article, and their members, under the article's key as story_id."""
    keyed = stories.by_article(_scored(spark, sf_dir))
    records = stories.story_records(keyed, NOW).drop("story_id").withColumnRenamed("story_key", "story_id")
    return records, keyed.withColumnRenamed("story_key", "story_id").withColumn("at", r.timeline(F.col("published_at"), F.col("first_seen_at"), NOW))


def hot_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.hot_board(*_story_tables(spark, sf_dir), NOW)


HOT_BOARD_SQL = f"""
with {STORIES_SQL}, t as (select url, bool_or(site_id = 'official_ai' or source_tier in ('official', 'curated')) as trusted from scored group by url), h as (
  select story_key as story_id, {_pct('score')} as pct, item_count, latest, greatest({_d(0)}, ({NOW_S} - latest) / 3600.0) as age, trusted from stories join t on story_key = url
)
select story_id, cast(greatest(1, least(100, floor((least({_d(1)}, pct / 100.0) * {_d(0.45)} + least({_d(1)}, (item_count - 1) / 3.0) * {_d(0.35)} + exp(-age / 12) * {_d(0.2)}) * 100 + 0.5))) as integer) as hot_score, pct, item_count
from h where age <= 24 and (item_count >= 2 or pct >= 82 or (trusted and pct >= 76)) order by hot_score desc, pct desc, item_count desc, latest desc, story_id limit 20
"""


def story_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe stories with a word in any member, and with a member of a site."""
    records, members = _story_tables(spark, sf_dir)
    records = reading.safe_stories(records, members)
    words = reading.matching_stories(records, members, query="the").select(F.lit("words").alias("filter"), "story_id", "item_count")
    return words.union(reading.matching_stories(records, members, site="zeli").select(F.lit("site"), "story_id", "item_count"))


STORY_SEARCH_SQL = f"""
with {STORIES_SQL}
select 'words' as filter, story_key as story_id, item_count from stories where story_key in (select url from scored where contains(lower(title || ' ' || source), 'the'))
union all select 'site', story_key, item_count from stories where story_key in (select url from scored where site_id = 'zeli')
"""


def curated_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that share an identity key with one of the brief."""
    records, members = _story_tables(spark, sf_dir)
    brief = stories.passing_brief(records).orderBy(F.desc("score"), "latest_at", "title", "story_id").limit(20)
    return reading.curated_stories(records, members, brief)


CURATED_STORIES_SQL = f"""
with {STORIES_SQL}, own as (
  select story_key as s, story_key as id, title, story_key as url from stories union all select url, id, title, url from scored
), keys as (
  select distinct s, unnest([case when url <> '' then 'url:' || url end, 'id:' || id, case when title <> '' then 'event:' || {_event_key('title')} end, case when title <> '' then 'title:' || left({_EVENT_TEXT.format(t='title')}, 34) end]) as k from own
), brief as (
  select story_key from stories where item_count >= 2 or score >= 0.72 order by score desc, latest, title, story_key limit 20
)
select distinct s as story_id from keys where k in (select k from keys where k is not null and s in (select story_key from brief))
"""


def story_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per story: reports, how long it grew, the older page's hotness and the busiest of twelve buckets."""
    records, members = _story_tables(spark, sf_dir)
    times = reading.report_times(members)
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(NOW)) - F.unix_micros("latest_at")) / 3.6e9)
    counts = times.groupBy("story_id").agg(F.count("*").alias("reports"))
    return records.join(counts, "story_id").select("story_id", "reports", reading.duration_label(F.col("earliest_at"), F.col("latest_at")).alias("lasted"), F.round(reading.spread_hotness(F.col("item_count"), age), 6).alias("spread"))


STORY_TIMES_SQL = f"""
with {STORIES_SQL}, e as (select url, min(at_s) as a, max(at_s) as b, count(*) as n from scored group by url), m as (select *, cast(floor((b - a) / 60.0 + 0.5) as bigint) as mins from e)
select url as story_id, cast(1 as bigint) as reports,
       case when a = b then '' when mins < 20 then '短时集中' when mins < 60 then '发酵 ' || cast(mins as varchar) || ' 分钟' when mins % 60 > 0 then '发酵 ' || cast(mins // 60 as varchar) || '小时' || cast(mins % 60 as varchar) || '分'
            else '发酵 ' || cast(mins // 60 as varchar) || '小时' end as lasted,
       round(case when n >= 2 then (n - 1) * exp(-greatest({_d(0)}, ({NOW_S} - b) / 3600.0) / 12) else {_d(0)} end, 6) as spread
from m
"""

def story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories as rows of the list: section, source signals, further members."""
    keyed = written(stories.by_article(reading.viewed(_scored(spark, sf_dir), NOW)).withColumnRenamed("story_key", "story_id"))
    records = stories.story_records(keyed.withColumnRenamed("story_id", "story_key"), NOW).drop("story_id").withColumnRenamed("story_key", "story_id")
    return reading.story_rows(records.select("story_id", "primary_id", "url"), keyed).select("story_id", "section", F.array_join("signals", "|").alias("signals"), "others")


STORY_ROWS_SQL = f"""
with {STORIES_SQL}, {SEEN_SQL.replace(SCORED_SQL + ", ", "")}
select url as story_id, max(case when id = primary_id then section end) as section, array_to_string(list_sort(list_distinct(list(signal))), '|') as signals, count(*) as others from seen join stories on url = story_key group by url
"""


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 sites of the status list: by tier, share kept, items and name."""
    items = _scored(spark, sf_dir)
    asked = items.select("source").distinct().select(F.col("source").alias("site_id"), F.col("source").alias("site_name"))
    order = status.status_order(site_rank(F.col("site_id")))
    first = status.site_table(items, items.where("ai_is_related"), asked).orderBy(*order).limit(60)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


SOURCE_HEALTH_SQL = f"""
with {SCORED_SQL}, t as (
  select site_id, max(source) as site_name, count_if(ai_is_related) as count, count(*) as raw_count, max(source_tier_rank) as r from scored group by 1 union all select distinct source, source, 0, 0, 9 from scored
)
select site_id, site_name, count, raw_count, cast(place as integer) as place from (select *, row_number() over (order by r, count / greatest(1, raw_count) desc, count desc, site_name) as place from t) where place <= 60
"""


def relevance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.relevance_audit(_scored(spark, sf_dir))


RELEVANCE_AUDIT_SQL = f"""
with {SCORED_SQL}
select 'label' as part, ai_label as name, count(*) as n, cast(null as double) as share from scored group by 2 union all select 'site', site_id, count_if(ai_is_related), round(count_if(ai_is_related) / count(*), 4) from scored group by 2
union all select 'review', id, 1, ai_score from (select * from scored where ai_score >= 0.45 and ai_score < 0.65 order by ai_score desc, id limit 20)
"""


def scoring_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commonest label changes, and the first items that either of two scorers keeps alone."""
    items, label = _scored(spark, sf_dir), F.col("ai_label")
    before = (F.col("ai_is_related"), label)
    after = ((F.col("ai_is_related") & (F.col("ai_score") >= 0.7)) | (F.size("ai_signals") >= 3), F.when(F.col("source_tier") == "official", "official").otherwise(label))
    moves = audit.label_moves(items, before, after).select(F.lit("move").alias("part"), F.concat_ws(">", "label_before", "label_after").alias("name"), "n")
    return moves.union(audit.flips(items, before[0], after[0]).select(F.col("flip"), "id", F.lit(1).cast("bigint")))


SCORING_MOVES_SQL = f"""
with {SCORED_SQL}, c as (
  select id, ai_is_related as x, (ai_is_related and ai_score >= 0.7) or len(signals) >= 3 as y, ai_label as m, case when source_tier = 'official' then 'official' else ai_label end as k from scored
)
select * from (select 'move' as part, m || '>' || k as name, count(*) as n from c where x and y and m <> k group by m, k order by n desc, m, k limit 20)
union all select * from (select 'dropped', id, 1 from c where x and not y order by id limit 30) union all select * from (select 'added', id, 1 from c where not x and y order by id limit 30)
"""

#: name: (query, SQL or None)
READING: dict[str, tuple[Query, str | None]] = {
    "item_view": (item_view, ITEM_VIEW_SQL),
    "source_forms": (source_forms, SOURCE_FORMS_SQL),
    "item_pages": (item_pages, ITEM_PAGES_SQL),
    "item_search": (item_search, ITEM_SEARCH_SQL),
    "section_view": (section_view, SECTION_VIEW_SQL),
    "section_stories": (section_stories, SECTION_STORIES_SQL),
    "item_labels": (item_labels, ITEM_LABELS_SQL),
    "event_clusters": (event_clusters, EVENT_CLUSTERS_SQL),
    "event_boards": (event_boards, EVENT_BOARDS_SQL),
    "source_groups": (source_groups, SOURCE_GROUPS_SQL),
    "site_groups": (site_groups, SITE_GROUPS_SQL),
    "leading_lists": (leading_lists, LEADING_LISTS_SQL),
    "hot_board": (hot_board, HOT_BOARD_SQL),
    "story_search": (story_search, STORY_SEARCH_SQL),
    "curated_stories": (curated_stories, CURATED_STORIES_SQL),
    "story_times": (story_times, STORY_TIMES_SQL),
    "story_rows": (story_rows, STORY_ROWS_SQL),
    "source_health": (source_health, SOURCE_HEALTH_SQL),
    "relevance_audit": (relevance_audit, RELEVANCE_AUDIT_SQL),
    "scoring_moves": (scoring_moves, SCORING_MOVES_SQL),
}
