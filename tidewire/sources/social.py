"""Posts of searches and lists, and digests of mail: answers of services as rows, with what was left out and why."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import allowed_domain, sender_domain, snippet, stripped
from ..functions.times import written_date
from .payloads import _item

#: Kinds of posts of a list that count, and the counts that a post tells.
OWN_TYPES = ["tweet", "quote"]
COUNTS = ["reply_count", "retweet_count", "quote_count", "favorite_count", "bookmark_count", "views_count"]

_POST = f"struct<id_str:string,id:string,type:string,full_text:string,text:string,lang:string,tweet_created_at:string,created_at:string,user:struct<screen_name:string,default_profile_image:boolean>,{','.join(f'{c}:long' for c in COUNTS)}>"
_MAIL = "struct<message_id:string,from:string,subject:string,preview:string,timestamp:string,created_at:string,attachments:array<string>>"


def _filled(*texts: str) -> Column:
    """The first that isn't empty, as it stands."""
    return F.coalesce(*(F.nullif(F.col(t), F.lit("")) for t in texts), F.lit(""))


def _posts(payloads: DataFrame, unnamed: str, now: datetime) -> DataFrame:
    """(pos, at, post_id, kind, bot, user, raw item) of every post in answers (pos, body as JSON), in their order."""
    rows = payloads.select("pos", F.posexplode(F.from_json("body", f"tweets array<{_POST}>")["tweets"]).alias("at", "t")).where("t is not null")
    name = stripped(F.ltrim(stripped(_filled("t.user.screen_name")), F.lit("@")))
    user = F.coalesce(F.nullif(name, F.lit("")), F.lit(unnamed))
    post = stripped(_filled("t.id_str", "t.id"))
    url = F.concat(F.lit("https://x.com/"), user, F.lit("/status/"), post)
    told = _item("socialdata_x", "SocialData X", F.concat(F.lit("@"), user), snippet(_filled("t.full_text", "t.text"), 220), url, F.coalesce(written_date(_filled("t.tweet_created_at", "t.created_at")), F.lit(now)))
    return rows.select("pos", "at", post.alias("post_id"), F.lower(F.coalesce(F.nullif("t.type", F.lit("")), F.lit("tweet"))).alias("kind"), F.coalesce("t.user.default_profile_image", F.lit(False)).alias("bot"), user.alias("user"), *told, F.col("t.lang").alias("lang"), F.struct(*(F.col(f"t.{c}").alias(c) for c in COUNTS)).alias("counts"))


def _once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("post_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "post_id"]), F.struct("pos", "at")).alias("row")).select("post_id", "row.*")


def searched_posts(payloads: DataFrame, now: datetime, most: int | None = None) -> DataFrame:
    """Items of searches' answers (pos, body as JSON), each post once, the first `most` of them in the order of the answers."""
    rows = _once(_posts(payloads, "i/web", now).where("post_id <> '' and title <> ''")).drop("kind", "bot", "user")
    return (rows.orderBy("pos", "at").limit(most) if most else rows).drop("pos", "at")


def judged_list(payloads: DataFrame, now: datetime, excluded: list[str] = ()) -> DataFrame:
    """Every post of a list's answers with `skipped`: why it is left out, null for those that stay."""
    names = [x for h in excluded if (x := h.strip().lstrip("@").lower())]
    rows = _posts(payloads, "", now)
    why = (
        F.when(~F.col("kind").isin(OWN_TYPES), "retweet_or_reply").when(F.lower("user").isin(names) if names else F.lit(False), "excluded_author").when(F.col("bot"), "bot_like")
        .when((F.col("post_id") == "") | (F.col("title") == "") | (F.col("user") == ""), "empty")
    )
    rows = rows.withColumn("skipped", why)
    first = rows.where("skipped is null").groupBy("post_id").agg(F.min(F.struct("pos", "at")).alias("first"))
    again = F.col("skipped").isNull() & (F.struct("pos", "at") != F.col("first"))
    return rows.join(first, "post_id", "left").withColumn("skipped", F.when(again, "duplicate").otherwise(F.col("skipped"))).drop("first")


def listed_posts(judged: DataFrame, most: int | None = None) -> DataFrame:
    """The posts that stay, the first `most` of them in the order of the answers."""
    rows = judged.where("skipped is null")
    return (rows.orderBy("pos", "at").limit(most) if most else rows).drop("pos", "at", "skipped", "bot", "user")


def skipped_counts(judged: DataFrame) -> DataFrame:
    """(skipped, n): how many posts were left out for what."""
    return judged.where("skipped is not null").groupBy("skipped").agg(F.count("*").alias("n"))


def mail_digest(payloads: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """What may be told of mails in answers (pos, body as JSON) from the allowed domains, all if none are named: no address, no body."""
    rows = payloads.select("pos", F.posexplode(F.from_json("body", f"messages array<{_MAIL}>")["messages"]).alias("at", "m")).where("m is not null")
    domain = sender_domain(F.coalesce("m.from", F.lit("")))
    mark = F.when(F.coalesce("m.message_id", F.lit("")) != "", F.left(F.sha1("m.message_id"), F.lit(12))).otherwise("unknown")
    out = rows.select(
        "pos", "at", F.concat(F.lit("agentmail:"), mark).alias("id"), domain.alias("sender_domain"), F.concat_ws(" · ", F.lit("AgentMail"), domain).alias("source"), snippet(F.coalesce("m.subject", F.lit("")), 180).alias("subject"),
        snippet(F.coalesce("m.preview", F.lit("")), 240).alias("preview"), F.nullif(_filled("m.timestamp", "m.created_at"), F.lit("")).alias("received_at"), F.greatest(F.lit(0), F.coalesce(F.size("m.attachments"), F.lit(0))).alias("attachments"),
    )
    return out.where(F.coalesce(allowed_domain(F.col("sender_domain"), list(allowed)), F.lit(False)))


def platform_counts(items: DataFrame, asked: DataFrame) -> DataFrame:
    """(site_id, site_name, n): items of each platform that was asked (site_id, site_name), 0 where there are none."""
    counts = items.groupBy("site_id").agg(F.count("*").alias("n"))
    return asked.join(counts, "site_id", "left").select("site_id", "site_name", F.coalesce("n", F.lit(0)).alias("n"))
