"""The keyed archive: item ids, upsert, retention, time window and block list."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..functions.times import event_time
from ..functions.urls import normalized

LAST_WINS = ["site_id", "site_name", "source", "title", "url"]


def item_id(site: Column, source: Column, title: Column, url: Column) -> Column:
    """SHA-1 of site, source and title (stripped, lower-cased) and the normalized URL."""
    low = lambda c: F.lower(stripped(F.coalesce(c, F.lit(""))))
    return F.sha1(F.concat_ws("||", low(site), low(source), low(title), normalized(F.coalesce(url, F.lit("")))))


def fits(items: DataFrame) -> DataFrame:
    """Rows with a title and an http URL."""
    return items.where((stripped(F.col("title")) != "") & stripped(F.col("url")).rlike("^http"))


def upserted(archive: DataFrame, batch: DataFrame, now: datetime) -> DataFrame:
    """The archive after a batch (with `pos`, its order of arrival).

    New rows get first_seen_at and last_seen_at of now. Known rows take the
    last site, source, title and URL; their published time only where they had
    none, or on subscribed feeds, where the last known one counts. Both sides
    are reduced by id before one full join. archive: id, LAST_WINS,
    published_at, first_seen_at, last_seen_at. Rows with a null id go.
    """
    known = F.col("published_at").isNotNull()
    last = batch.where("id is not null").groupBy("id").agg(
        F.max_by(F.struct(*LAST_WINS), "pos").alias("new"),
        F.min_by("published_at", F.when(known, F.col("pos"))).alias("first_published"),
        F.max_by("published_at", F.when(known, F.col("pos"))).alias("last_published"),
    )
    old = archive.select("id", *(F.col(c).alias(f"old_{c}") for c in archive.columns if c != "id"))
    published = F.when(F.col("new.site_id") == "opmlrss", F.coalesce("last_published", "old_published_at")).otherwise(F.coalesce("old_published_at", "first_published"))
    return old.join(last, "id", "full_outer").select(
        "id",
        *(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in LAST_WINS),
        published.alias("published_at"),
        F.coalesce("old_first_seen_at", F.lit(now)).alias("first_seen_at"),
        F.when(F.col("new").isNotNull(), F.lit(now)).otherwise(F.col("old_last_seen_at")).alias("last_seen_at"),
    )


def retained(archive: DataFrame, now: datetime, days: int = 21) -> DataFrame:
    """Rows seen, or else published, within the days; rows without any time stay."""
    at = F.coalesce("last_seen_at", "published_at", "first_seen_at", F.lit(now))
    return archive.where(at >= F.lit(now) - F.make_dt_interval(days=F.lit(days)))


def with_event_time(items: DataFrame) -> DataFrame:
    return items.withColumn("event_time", event_time(F.col("site_id"), F.col("published_at"), F.col("first_seen_at")))


def in_window(items: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Rows whose event_time isn't before the window; unknown times go."""
    return items.where(F.col("event_time") >= F.lit(now) - F.make_dt_interval(hours=F.lit(hours)))


def unblocked(items: DataFrame, ids: list[str], urls: list[str], sources: list[str]) -> DataFrame:
    """Rows named neither by id, nor by normalized URL, nor by source; the lists are short settings."""
    hit = lambda c, names: F.coalesce(c.isin(names), F.lit(False)) if names else F.lit(False)
    return items.where(~(hit(F.col("id"), ids) | hit(normalized(F.col("url")), urls) | hit(F.col("source"), sources)))


def without_blocked(items: DataFrame, blocked: DataFrame) -> DataFrame:
    """items but for those that a table (kind, value) of any size names: by id, url (normalized) or source."""
    out = items.withColumn("_url", normalized(F.coalesce("url", F.lit(""))))
    for kind, column in (("id", F.col("id").cast("string")), ("url", F.col("_url")), ("source", F.col("source"))):
        value = F.col("value") if kind != "url" else normalized(F.col("value"))
        names = blocked.where(F.col("kind") == kind).select(value.alias("_name")).distinct()
        out = out.join(names, column == F.col("_name"), "left_anti")
    return out.drop("_url")
