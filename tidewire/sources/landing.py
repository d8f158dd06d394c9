"""Landed payloads as rows; one read a source, one schema for all."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeezed, stripped

RAW_ITEM = "site_id string, site_name string, source string, title string, url string, published_at timestamp, meta map<string,string>"
FEED_DATES = ("pubDate", "published", "updated")


def feed_items(spark: SparkSession, path: str, site_id: str, site_name: str, row_tag: str = "item") -> DataFrame:
    """RSS (`item`) or Atom (`entry`) files as raw items; undated or broken dates give null, repeats of (title, link) count once."""
    schema = "title string, link string, pubDate string, published string, updated string, author string"
    if row_tag == "entry":
        schema = schema.replace("link string", "link struct<_href:string,_VALUE:string>")
    rows = spark.read.option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).xml(path)
    link = F.coalesce("link._href", "link._VALUE") if row_tag == "entry" else F.col("link")
    text = F.coalesce(*FEED_DATES)
    plain = F.regexp_replace(stripped(text), r"^[A-Za-z]{3},\s*", "")
    at = F.coalesce(*(F.try_to_timestamp(plain, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))
    items = rows.select(
        F.lit(site_id).alias("site_id"), F.lit(site_name).alias("site_name"), F.coalesce(stripped(F.col("author")), F.lit(site_name)).alias("source"), squeezed(F.col("title")).alias("title"),
        stripped(link).alias("url"), at.alias("published_at"), F.lit(None).cast("map<string,string>").alias("meta"),
    )
    return items.where("title <> '' and url <> ''").dropDuplicates(["title", "url"])


def subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """(title, feed_url, page_url) of the feeds in OPML files, each feed once, under its title, else text, else URL."""
    rows = spark.read.text(path, wholetext=True)
    tag = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<outline\b([^>]*?)/?>"), 1)).alias("tag")
    value = lambda name: F.nullif(F.regexp_extract("tag", rf'\b{name}="([^"]*)"', 1), F.lit(""))
    found = rows.select(tag).select(F.coalesce(value("title"), value("text"), value("xmlUrl")).alias("title"), value("xmlUrl").alias("feed_url"), value("htmlUrl").alias("page_url"))
    return found.where("feed_url is not null").groupBy("feed_url").agg(F.min(F.struct("title", "page_url")).alias("x")).select("x.title", "feed_url", "x.page_url")


def json_items(spark: SparkSession, path: str, fields: dict[str, str], site_id: str, site_name: str, explode: str | None = None) -> DataFrame:
    """JSON files as raw items. fields: SQL expressions for source, title, url and published_at, over the record or the exploded `row`."""
    rows = spark.read.option("multiLine", True).json(path)
    if explode:
        rows = rows.select(F.explode(explode).alias("row"))
    return rows.select(
        F.lit(site_id).alias("site_id"), F.lit(site_name).alias("site_name"), *(F.expr(fields[k]).alias(k) for k in ("source", "title", "url")),
        F.expr(fields["published_at"]).cast("timestamp").alias("published_at"), F.lit(None).cast("map<string,string>").alias("meta"),
    )


def union_of(parts: list[DataFrame]) -> DataFrame:
    """All rows of the sources, by column name."""
    out, *rest = parts
    for part in rest:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def archive_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The archive, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def html_context(html, paragraphs: int = 3, limit: int = 800):
    """The description and the first paragraphs of pages, tags gone, cut to `limit`."""
    said = F.regexp_extract(html, r"""(?is)<meta[^>]+name=["']description["'][^>]*content=["']([^"']*)""", 1)
    texts = F.transform(F.slice(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1), 1, paragraphs), lambda p: squeezed(F.regexp_replace(p, r"(?s)<[^>]+>", " ")))
    return F.left(F.array_join(F.filter(F.concat(F.array(squeezed(said)), texts), lambda t: t != ""), "\n"), F.lit(limit))


#: Marks of a reader's text that aren't its body, and how much of a line must be prose.
READER_MARKS = ["title:", "url source:", "markdown content:"]
PROSE = 20
LINE_ENDS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def prose_line(line: Column) -> Column:
    """Enough is left of a markdown line without links, bullet and marks."""
    bare = F.regexp_replace(F.regexp_replace(line, r"!?\[[^\]]*\]\([^)]*\)", ""), r"(?U)^[*\-+]\s+|^\d+\.\s+", "")
    return F.length(squeezed(F.regexp_replace(bare, r"[#>*_`|]", " "))) >= PROSE


def reader_context(text: Column, lines: int = 40, prose: int = 3) -> Column:
    """Of a page rendered as markdown: its title line, and the first lines of prose among its first `lines`; empty for null."""
    # Marks are ASCII, so lower-casing keeps a line's beginning.
    marked = lambda line, *marks: reduce(or_, (F.startswith(F.lower(line), F.lit(m)) for m in marks))
    every = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_ENDS), stripped)
    title = F.slice(F.filter(every, lambda x: marked(x, READER_MARKS[0])), 1, 1)
    body = F.filter(F.slice(every, 1, lines), lambda x: ~marked(x, *READER_MARKS) & prose_line(x))
    return F.array_join(F.concat(title, F.slice(body, 1, prose)), "\n")
