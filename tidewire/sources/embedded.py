"""Data that pages carry for their scripts, and what is read from it.

Where a value begins is found by built-in expressions; where it ends is told by
its brackets, which a small helper counts, strings and their escapes aside.
"""

from __future__ import annotations

import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_non_empty, stripped
from ..functions.times import any_date, unix_time
from .payloads import _item

#: Where a wiki's data stands, what a list of sources begins with, its keys that name none, and the sources where it can't be read.
CLIENT_VARS = "window.DATA = Object.assign({}, window.DATA, { clientVars: Object("
SOURCES_MARK = "{v2ex:vL"
NO_SOURCES = ["name", "column", "home", "https", "color", "interval", "title", "type", "redirect", "desc"]
DEFAULT_SOURCES = ["hackernews", "producthunt", "github", "sspai", "juejin", "36kr"]
CLOSING = {"(": ")", "[": "]", "{": "}"}


def balanced(text: str, at: int) -> int | None:
    """Where the bracket that opens at `at` ends (behind its partner); None if it never does. Only brackets of its kind count."""
    opening, closing = text[at], CLOSING[text[at]]
    depth = 0
    for m in re.compile(rf'"(?:[^"\\]|\\.)*"|["\{opening}\{closing}]', re.S).finditer(text, at):
        if m[0] == '"':
            return None  # a string without an end
        depth += (m[0] == opening) - (m[0] == closing)
        if depth == 0 and len(m[0]) == 1:
            return m.end()
    return None


def bracketed(rest: Column) -> Column:
    """The value at the start of a text, up to the partner of its first bracket; null for any other text."""

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([t[:end] if t and t[0] in CLOSING and (end := balanced(t, 0)) else None for t in texts], dtype=object)

    return F.pandas_udf(each, "string")(rest)


def _behind(text: Column, mark: str) -> Column:
    """What stands behind the first such mark; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def client_vars(html: Column) -> Column:
    """The data of a wiki's page as JSON; null where there is none."""
    inner = bracketed(F.concat(F.lit("("), _behind(html, CLIENT_VARS)))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def streamed(html: Column) -> Column:
    """The chunks that a page pushes to its script, joined in their order and unescaped (as they are if that fails)."""
    merged = F.array_join(F.regexp_extract_all(html, F.lit(r'(?s)self\.__next_f\.push\(\[1,"(.*?)"\]\)</script>'), 1), "")
    return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), merged, F.lit('"]')), "array<string>"), 0), merged)


def keyed_value(text: Column, key: str) -> Column:
    """The object or array behind the first `key` (as it is written, quotes included) as JSON; null where there is none."""
    rest = F.regexp_extract(_behind(text, key), r"(?s)^[^:]*:[^\[{]*([\[{].*)$", 1)
    value = F.replace(bracketed(rest), F.lit("$undefined"), F.lit("null"))
    return F.regexp_replace(value, r'"\$D([^"]+)"', r'"$1"')


def listed_feeds(pages: DataFrame) -> DataFrame:
    """(page, pos, name, url) of the feeds that a page (page, body) lists for its script."""
    section = F.regexp_extract("body", r"(?s)const\s+feeds\s*=\s*\[(.*?)\]\s*;", 1)
    pattern = r"\{\s*name:\s*'([^']+)'\s*,\s*url:\s*'([^']+)'\s*\}"
    found = F.arrays_zip(F.regexp_extract_all(section, F.lit(pattern), 1).alias("name"), F.regexp_extract_all(section, F.lit(pattern), 2).alias("url"))
    return pages.select("page", F.posexplode(found).alias("pos", "f")).select("page", "pos", "f.name", "f.url")


def listed_feed_items(feeds: DataFrame, entries: DataFrame, now: datetime, most: int = 500) -> DataFrame:
    """Items of the entries (feed_url, at, title, link, published) of listed feeds, in the order of the list, `most` at most."""
    rows = feeds.join(entries, feeds["url"] == entries["feed_url"]).select("pos", "at", *_item("iris", "Info Flow", F.col("name"), stripped(F.coalesce("title", F.lit(""))), stripped(F.coalesce("link", F.lit(""))), any_date(F.col("published"), now)))
    return rows.where("title <> '' and url <> ''").orderBy("pos", "at").limit(most).drop("pos", "at")


def newsletters(payloads: DataFrame) -> DataFrame:
    """Issues in answers (pos, body as JSON) of a newsletter's list, each once; numbers of seconds or milliseconds as times."""
    schema = "data struct<dataList:array<struct<id:string,title:string,createdTimestamp:string,articleCount:long>>>"
    rows = payloads.select("pos", F.posexplode(F.from_json("body", schema)["data"]["dataList"]).alias("at", "x"))
    url = F.concat(F.lit("https://www.bestblogs.dev/en/newsletter#"), stripped(F.col("x.id")))
    items = rows.where("trim(x.id) <> '' and trim(x.title) <> ''").select("pos", "at", *_item("bestblogs", "BestBlogs", "Weekly Newsletter", stripped(F.col("x.title")), url, unix_time(F.col("x.createdTimestamp"))), F.col("x.articleCount").alias("articles"))
    columns = [c for c in items.columns if c not in ("pos", "at")]
    return items.groupBy("url").agg(F.min_by(F.struct(*columns), F.struct("pos", "at")).alias("row")).select("row.*")


def listed_sources(script: Column) -> Column:
    """The ids of the sources that a script's table names, in its order; the default ones where it can't be read."""
    block = bracketed(F.concat(F.lit(SOURCES_MARK), _behind(script, SOURCES_MARK)))
    keys = F.regexp_extract_all(block, F.lit(r"""(["']?)([a-zA-Z0-9_-]+)\1\s*:"""), 2)
    told = F.array_distinct(F.filter(keys, lambda k: ~k.isin(NO_SOURCES)))
    return F.coalesce(told, F.array(*map(F.lit, DEFAULT_SOURCES)))


def source_items(payloads: DataFrame, now: datetime) -> DataFrame:
    """Items of answers (pos, body as JSON: blocks, bare or under data) with a source each; undated ones get the block's time, else now."""
    block = "struct<id:string,title:string,name:string,desc:string,updatedTime:string,items:array<struct<title:string,url:string,pubDate:string,extra:struct<date:string>>>>"
    blocks = F.coalesce(F.from_json("body", f"data array<{block}>")["data"], F.from_json("body", f"array<{block}>"))
    rows = payloads.select("pos", F.posexplode(blocks).alias("at", "b")).select("pos", "at", "b", F.posexplode("b.items").alias("k", "x"))
    own = F.coalesce(F.nullif("b.id", F.lit("")), F.lit("unknown"))
    name = first_non_empty(F.col("b.title"), F.col("b.name"), F.col("b.desc"), own)
    source = F.when(name != own, F.concat(name, F.lit(" ("), own, F.lit(")"))).otherwise(own)
    at = F.coalesce(any_date(F.col("x.pubDate"), now), any_date(F.col("x.extra.date"), now), unix_time(F.col("b.updatedTime")), F.lit(now))
    items = rows.select(*_item("newsnow", "NewsNow", source, stripped(F.coalesce("x.title", F.lit(""))), stripped(F.coalesce("x.url", F.lit(""))), at))
    return items.where("title <> '' and url <> ''")
