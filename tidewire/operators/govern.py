"""What must hold before anything is published."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redacted, stripped
from ..functions.urls import public

SUMMARY_CHARS = 360


def published_view(items: DataFrame, texts: list[str], urls: list[str], summaries: list[str] = ()) -> DataFrame:
    """items with texts redacted, URLs made public and summaries cut as well."""
    cutted = lambda c: F.when(F.length(c) > SUMMARY_CHARS, F.concat(F.regexp_replace(F.left(c, F.lit(SUMMARY_CHARS - 1)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(c)
    return items.withColumns(
        {c: redacted(F.col(c)) for c in texts} | {c: redacted(public(F.col(c))) for c in urls} | {c: cutted(redacted(F.col(c))) for c in summaries}
    )


def leaks(items: DataFrame, texts: list[str]) -> DataFrame:
    """(id, field): each text that still holds a mail address or a secret."""
    return items.select("id", F.explode(F.array_compact(F.array(*(F.when(redacted(F.col(c)) != F.col(c), F.lit(c)) for c in texts)))).alias("field"))


def gate(items: DataFrame, sites: DataFrame, brief: DataFrame, now: datetime, max_age_hours: int = 36, min_success: float = 0.70, min_brief: int = 5, min_latest: int = 20) -> DataFrame:
    """(rule, ok, value): one row for each rule. sites: (site_id, ok); items: (id, title, url, event_time)."""
    bad = F.count_if((F.coalesce(F.length("id").cast("int"), F.lit(0)) == 0) | (F.coalesce(stripped(F.col("title")), F.lit("")) == "") | ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)))
    a = items.agg(F.count("*").alias("n"), bad.alias("bad"), ((F.unix_micros(F.lit(now)) - F.unix_micros(F.max("event_time"))) / 3.6e9).alias("age"))
    b = sites.agg(F.count("*").alias("sites"), F.avg(F.col("ok").cast("int")).alias("success"))
    c = brief.agg(F.count("*").alias("brief"))
    one = a.join(b).join(c)  # three tables of one row
    rule = lambda name, ok, value: F.struct(F.lit(name).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok"), value.cast("double").alias("value"))
    rules = [
        rule("fresh", F.col("age") <= max_age_hours, F.col("age")), rule("adapters", F.col("sites") >= 5, F.col("sites")), rule("success", F.col("success") >= min_success, F.col("success")),
        rule("brief", F.col("brief") >= min_brief, F.col("brief")), rule("latest", F.col("n") >= min_latest, F.col("n")), rule("shape", F.col("bad") == 0, F.col("bad")),
    ]
    return one.select(F.inline(F.array(*rules)))
