"""Pages as tables of their elements, from which Spark selects; tags may be nested, unclosed or closed twice."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..functions.times import any_date
from ..functions.urls import joined
from ..operators.graph import written
from .payloads import _item

#: Elements without an end, and those whose text is no text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style"}
#: Characters of pages whose elements are handed on together.
FRAME_CHARS = 1 << 20


class _Elements(HTMLParser):
    """Elements in the order of their starts; an end tag closes what is open within its partner, one without a partner nothing."""

    def __init__(self, tags: set[str] | None) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.count, self.open, self.out, self.pieces, self.last_was_text = tags, 0, [], [], [], False

    def handle_starttag(self, tag, attrs):
        self.last_was_text = False
        self.count += 1
        kept = None
        if self.tags is None or tag in self.tags:
            kept = {"pos": self.count, "last": self.count, "depth": len(self.open) + 1, "tag": tag, "attributes": {k: v or "" for k, v in reversed(attrs)}, "text": ""}
            self.out.append(kept)
        if tag not in VOID:
            self.open.append((tag, kept, len(self.pieces)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.last_was_text = False
        if tag not in VOID and any(t == tag for t, _, _ in reversed(self.open)):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1][0] in SILENT:
            return
        if self.last_was_text:
            self.pieces[-1] += data
        else:
            self.pieces.append(data)
        self.last_was_text = True

    def _close(self) -> str:
        tag, kept, start = self.open.pop()
        if kept is not None:
            kept["last"] = self.count
            kept["text"] = " ".join(filter(None, map(str.strip, self.pieces[start:])))
        return tag

    def read(self, html: str) -> list[dict]:
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError):  # markup that can't be read ends there
            pass
        while self.open:
            self._close()
        return self.out


def elements(pages: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(page, pos, last, depth, tag, attributes, text) of the elements of pages (page, html), of all tags if none are named.

    pos numbers all elements of a page in the order of their starts, last is
    the pos of the last one within; text is what stands within, each run
    stripped, with a blank between runs. Of repeated attributes the first
    counts. Null and empty pages have none; unread markup ends a page.
    """
    names = set(tags) if tags is not None else None
    columns = ["page", "pos", "last", "depth", "tag", "attributes", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, size = [], 0
            for page, html in zip(frame["page"], frame["html"]):
                out += [{"page": page, **x} for x in _Elements(names).read(html or "")]
                size += len(html or "")
                if size > FRAME_CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    kind = pages.schema["page"].dataType.simpleString()
    return pages.select("page", "html").mapInPandas(run, f"page {kind}, pos int, last int, depth int, tag string, attributes map<string,string>, text string")


def has_class(*names: str) -> Column:
    own = F.split(F.coalesce(F.col("attributes")["class"], F.lit("")), r"\s+")
    out = F.lit(True)
    for name in names:
        out = out & F.array_contains(own, name)
    return out


def within(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """inner's elements with `outer`, the pos of each element of outer that they lie in."""
    ends = outer.select("page", F.col("pos").alias("outer"), F.col("last").alias("_last"))
    return inner.join(ends, "page").where((F.col("pos") > F.col("outer")) & (F.col("pos") <= F.col("_last"))).drop("_last")


def first_within(outer: DataFrame, inner: DataFrame, value: Column, name: str) -> DataFrame:
    """(page, pos, name): of each element of outer that has one of inner in it, the value of the first."""
    rows = within(outer, inner).withColumn("_v", value)
    return rows.groupBy("page", F.col("outer").alias("pos")).agg(F.min_by("_v", "pos").alias(name))


def _of(all_: DataFrame, tag: str | None, *classes: str) -> DataFrame:
    rows = all_.where(has_class(*classes)) if classes else all_
    return rows.where(F.col("tag") == tag) if tag else rows


def publisher_items(pages: DataFrame, now: datetime) -> DataFrame:
    """Items of an aggregator's page (page, html) of publishers' blocks: links with a source and a hint of their time."""
    all_ = written(elements(pages))
    block = _of(all_, "div", "publisher-block")
    label = within(block, _of(all_, None, "publisher-text"))
    inner = lambda name: within(label.select("page", "pos", "last"), _of(all_, None, name)).drop("outer")
    named = block.select("page", "pos", F.coalesce(F.col("attributes")["data-publisher"], F.lit("unknown")).alias("own"))
    for name in ("primary", "secondary"):
        named = named.join(first_within(block, inner(name), F.col("text"), name), ["page", "pos"], "left")
    source = F.coalesce("primary", "own")
    named = named.select("page", F.col("pos").alias("outer"), F.when((F.coalesce("secondary", F.lit("")) != "") & (F.col("secondary") != source), F.concat(source, F.lit(" · "), F.col("secondary"))).otherwise(source).alias("source"))
    row = within(block, _of(all_, "div", "publisher-link"))
    link = first_within(row, _of(all_, "a", "article-link"), F.struct(F.col("attributes")["href"].alias("href"), "text"), "link")
    aside = within(_of(all_, None, "aside").select("page", "pos", "last"), _of(all_, None, "text")).drop("outer")
    hint = first_within(row, aside, F.coalesce(F.nullif(F.col("attributes")["title"], F.lit("")), F.col("text")), "hint")
    found = row.select("page", "pos", "outer").join(named, ["page", "outer"]).join(link, ["page", "pos"]).join(hint, ["page", "pos"], "left").where("link.href <> ''")
    return found.select("page", "pos", *_item("techurls", "TechURLs", F.col("source"), F.col("link.text"), stripped(F.col("link.href")), any_date(F.coalesce("hint", F.lit("")), now)))


def headline_items(pages: DataFrame, now: datetime) -> DataFrame:
    """Items of a page (page, html) of links under /news/ with a heading."""
    all_ = written(elements(pages, ["a", "h3", "div", "span"]))
    link = _of(all_, "a").where(F.startswith(F.col("attributes")["href"], F.lit("/news/")))
    title = first_within(link, _of(all_, "h3"), F.col("text"), "title")
    grey = within(_of(all_, "div", "text-sm", "text-gray-400").select("page", "pos", "last"), _of(all_, "span")).drop("outer")
    hint = first_within(link, grey, F.col("text"), "hint")
    found = link.select("page", "pos", F.col("attributes")["href"].alias("href")).join(title, ["page", "pos"]).join(hint, ["page", "pos"], "left").where("title <> ''")
    return found.select("page", "pos", *_item("aibase", "AIbase", "AIbase", F.col("title"), joined("https://www.aibase.com", F.col("href")), any_date(F.coalesce("hint", F.lit("")), now)))


def newsletter_links(pages: DataFrame, now: datetime) -> DataFrame:
    """Items of a newsletter's page (page, html) where its list can't be had: links with titles of eight characters or more, each URL once."""
    all_ = written(elements(pages, ["a", "time"]))
    link = _of(all_, "a").where(F.contains(F.col("attributes")["href"], F.lit("/newsletter")))
    at = first_within(link, _of(all_, "time"), F.coalesce(F.nullif(F.col("attributes")["datetime"], F.lit("")), F.col("text")), "hint")
    url = joined("https://www.bestblogs.dev", stripped(F.col("attributes")["href"]))
    found = link.where(F.length("text") >= 8).join(at, ["page", "pos"], "left").select("page", "pos", *_item("bestblogs", "BestBlogs", "Weekly Newsletter", F.col("text"), url, any_date(F.coalesce("hint", F.lit("")), now)))
    return found.groupBy("url").agg(F.min_by(F.struct(*found.columns), F.struct("page", "pos")).alias("row")).select("row.*")


def script_bundle(pages: DataFrame, base: str) -> DataFrame:
    """(page, url) of the first script of pages (page, html) that is a bundle of the site's index."""
    scripts = elements(pages, ["script"]).where(F.contains(F.col("attributes")["src"], F.lit("/assets/index-")) & F.endswith(F.col("attributes")["src"], F.lit(".js")))
    return scripts.groupBy("page").agg(F.min_by(F.col("attributes")["src"], "pos").alias("src")).select("page", joined(base, F.col("src")).alias("url"))
