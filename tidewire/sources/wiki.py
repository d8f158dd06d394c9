"""Updates of a wiki whose pages are maps of blocks that name their parents."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed, stripped
from ..operators.graph import written

#: Kinds of blocks, what the recent log is called, how far above a block its day may stand.
HEADINGS, UPDATES = ["heading1", "heading2", "heading3"], ["bullet", "text", "todo", "ordered"]
RECENT_LOG = r"近 ?7 ?日更新日志"
HISTORY = r"历史更新|更新日志"
HOPS = 20

BLOCK = "struct<type:string,parent_id:string,text:struct<initialAttributedTexts:struct<text:map<string,string>>,apool:struct<numToAttrib:map<string,array<string>>>>>"


def _text(data: str) -> Column:
    """The pieces of a block's text in the order of their numbers."""
    pieces = F.transform(F.map_entries(f"{data}.text.initialAttributedTexts.text"), lambda e, k: F.struct(F.coalesce(e["key"].try_cast("int"), F.lit(0)).alias("n"), k.alias("k"), F.coalesce(e["value"], F.lit("")).alias("v")))
    return stripped(F.coalesce(F.array_join(F.transform(F.array_sort(pieces), lambda p: p["v"]), ""), F.lit("")))


def _mention(data: str) -> Column:
    """Title and URL of the first document that a block's text mentions by its title."""
    attributes = F.filter(F.map_values(f"{data}.text.apool.numToAttrib"), lambda v: (F.size(v) >= 2) & (v[0] == "inline-component"))
    parsed = F.transform(attributes, lambda v: F.from_json(v[1], "type string, data struct<title:string,raw_url:string>"))
    told = F.filter(parsed, lambda c: (c["type"] == "mention_doc") & (stripped(F.coalesce(c["data"]["title"], F.lit(""))) != ""))
    return F.get(F.transform(told, lambda c: F.struct(stripped(c["data"]["title"]).alias("title"), F.nullif(stripped(F.coalesce(c["data"]["raw_url"], F.lit(""))), F.lit("")).alias("url"))), 0)


def blocks(pages: DataFrame) -> DataFrame:
    """(page, pos, id, type, parent, text, mention) of the block maps of pages (page, body as JSON), in the maps' order."""
    rows = pages.select("page", F.posexplode(F.from_json("body", f"map<string,struct<data:{BLOCK}>>")).alias("pos", "id", "b"))
    return rows.select("page", "pos", "id", F.col("b.data.type").alias("type"), F.nullif(stripped(F.coalesce("b.data.parent_id", F.lit(""))), F.lit("")).alias("parent"), _text("b.data").alias("text"), _mention("b.data").alias("mention"))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month, day), F.lit("yyyy-M-d")).cast("date")


def heading_days(rows: DataFrame, now: datetime) -> DataFrame:
    """(page, id, day) of headings of a month and a day, on pages with a recent log those in it alone.

    A day has this year, or last year where it lies over two days ahead; one
    that this year hasn't has the year of the month's heading above it.
    """
    today = (now + timedelta(hours=8)).date()
    log = rows.where(F.col("type").isin(HEADINGS) & F.col("text").rlike(RECENT_LOG) & F.col("parent").isNotNull()).select("page", F.col("parent").alias("log")).distinct()
    months = rows.where("type = 'heading2'").select("page", F.col("id").alias("parent"), F.regexp_extract("text", r"(20\d{2})\s*年\s*\d{1,2}\s*月", 1).alias("year")).where("year <> ''")
    month, day = (F.regexp_extract("text", r"(\d{1,2})\s*月\s*(\d{1,2})\s*日", k) for k in (1, 2))
    days = rows.where("type = 'heading3'").select("page", "id", "parent", month.alias("m"), day.alias("d")).where("m <> ''")
    in_log = days.join(log, (days["page"] == log["page"]) & (days["parent"] == log["log"]), "left_semi")
    days = in_log.union(days.join(log.select("page").distinct(), "page", "left_anti")).join(months, ["page", "parent"], "left")
    this = _day(F.lit(today.year), F.col("m"), F.col("d"))
    return days.select("page", "id", F.when(this > F.lit(today + timedelta(days=2)), _day(F.lit(today.year - 1), F.col("m"), F.col("d"))).when(this.isNotNull(), this).otherwise(_day(F.coalesce("year", F.lit(str(today.year))), F.col("m"), F.col("d"))).alias("day")).where("day is not null")


def nearest_days(rows: DataFrame, days: DataFrame, hops: int = HOPS) -> DataFrame:
    """(page, id, day): the day of the nearest heading at most `hops` parents above a block.

    A round doubles how far each block has looked: what the block at the end of
    its way has found is its own finding. Ways in a circle end like any other.
    """
    of = days.select("page", F.col("id").alias("up"), "day")
    state = rows.where("parent is not null").select("page", "id", F.col("parent").alias("up")).join(of, ["page", "up"], "left")
    state = written(state.select("page", "id", "day", F.when(F.col("day").isNotNull(), 1).alias("far"), "up"))
    step = 1
    while step < hops:
        ahead = state.select("page", F.col("id").alias("up"), F.col("day").alias("d"), F.col("far").alias("f"), F.col("up").alias("next"))
        state = written(state.join(ahead, ["page", "up"], "left").select("page", "id", F.coalesce("day", "d").alias("day"), F.coalesce("far", F.col("f") + step).alias("far"), F.col("next").alias("up")))
        step *= 2
    return state.where(F.col("far") <= hops).select("page", "id", "day")


def updates(pages: DataFrame, now: datetime) -> DataFrame:
    """(page, date, title, summary, url) of the updates in block maps (page, url, body as JSON), each (date, title) of a page once.

    An update is a line under a day's heading. One that mentions a document
    with a link has its title and URL, and what else the line says as summary;
    any other is its own title and has the page's URL.
    """
    rows = written(blocks(pages))
    clean = lambda c: squeezed(F.regexp_replace(c, "《 ?》", ""))
    lines = rows.where(F.col("type").isin(UPDATES)).join(nearest_days(rows, heading_days(rows, now)), ["page", "id"]).join(pages.select("page", F.col("url").alias("page_url")), "page")
    linked = F.col("mention.url").isNotNull()
    title = F.when(linked, clean(F.col("mention.title"))).otherwise(clean(F.col("text")))
    said = F.when(linked, F.nullif(clean(F.col("text")), F.lit("")))
    told = lines.select("page", "pos", F.date_format("day", "yyyy-MM-dd").alias("date"), title.alias("title"), F.coalesce(said, title).alias("summary"), F.coalesce("mention.url", "page_url").alias("url")).where("title <> ''")
    return told.groupBy("page", "date", "title").agg(F.min_by(F.struct("summary", "url"), "pos").alias("x")).select("page", "date", "title", "x.summary", "x.url")


def history_url(html: Column, otherwise: str) -> Column:
    """Where a wiki's page links to its history: the first document that its script's data mentions under such a title."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r'(\{\\"id\\":\\"[^"]+\\",\\"type\\":\\"mention_doc\\",\\"data\\":\{[^}]+\}\})'), 1), lambda r: F.from_json(F.replace(F.replace(r, F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/")), "data struct<title:string,raw_url:string>")["data"])
    fit = F.filter(found, lambda d: d["title"].rlike(HISTORY) & (stripped(F.coalesce(d["raw_url"], F.lit(""))) != ""))
    return F.coalesce(F.get(F.transform(fit, lambda d: stripped(d["raw_url"])), 0), F.lit(otherwise))
