"""Time functions; `now` is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, stripped

#: A time up to so many hours ahead of now is believed.
SKEW_HOURS = 2


def unix_time(value: Column) -> Column:
    """Seconds, or milliseconds from 10**10 on; null for what is no number or not positive."""
    n = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(n > 1e10, F.timestamp_millis(n.cast("long"))).when(n > 0, F.timestamp_seconds(n))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def event_time(site: Column, published: Column, first_seen: Column) -> Column:
    """Published, else first seen; subscribed feeds count by their published time alone."""
    return F.when(site == "opmlrss", published).otherwise(F.coalesce(published, first_seen))


def freshness(at: Column, now: datetime, half_life_hours: float = 48.0) -> Column:
    """Halves each half-life; 0 for an unknown time, 1 for a future one."""
    age = F.greatest(F.lit(0.0), hours_between(F.lit(now), at))
    return F.coalesce(F.pow(F.lit(0.5), age / half_life_hours), F.lit(0.0))


def corrected_feeds(items: DataFrame, feed: str, published: str, now: datetime, chinese: Column) -> DataFrame:
    """items with `published` corrected, feed by feed.

    Where a Chinese feed's newest time is ahead of now by no more than a zone
    mix-up explains, all its times lose eight hours; else each is corrected by
    itself. The newest time of each feed is one combinable aggregate.
    """
    limit = F.lit(now) + F.make_dt_interval(hours=F.lit(SKEW_HOURS))
    eight = F.make_dt_interval(hours=F.lit(8))
    newest = items.groupBy(F.col(feed).alias("_feed")).agg(F.max(published).alias("_newest"))
    mixed_up = chinese & (F.col("_newest") > limit) & (F.col("_newest") - eight <= limit)
    at = F.col(published)
    single = F.when(chinese, corrected_future(at, now, True)).otherwise(corrected_future(at, now))
    out = items.join(newest, F.col(feed).eqNullSafe(F.col("_feed")))
    return out.withColumn(published, F.when(mixed_up, at - eight).otherwise(single)).drop("_feed", "_newest")


def corrected_future(published: Column, now: datetime, chinese_source: bool = False) -> Column:
    """A time too far ahead becomes eight hours less where a zone mix-up explains it, else now."""
    limit = F.lit(now) + F.make_dt_interval(hours=F.lit(SKEW_HOURS))
    back = published - F.make_dt_interval(hours=F.lit(8))
    fixed = F.when(back <= limit, back).otherwise(F.lit(now)) if chinese_source else F.lit(now)
    return F.when(published > limit, fixed).otherwise(published)


def relative_time_zh(text: Column, now: datetime) -> Column:
    """Times as Chinese pages tell them: so many minutes, hours or days ago, just now, yesterday, a time of today, a day of the year.

    A time of day over five minutes ahead is yesterday's, a day over two days
    ahead last year's. Null for anything else.
    """
    ago = lambda unit: F.regexp_extract(text, rf"(\d{{1,6}})\s*{unit}", 1).try_cast("int")
    at, plain = F.lit(now), stripped(text)
    clock = [F.regexp_extract(plain, r"^(?:今天)?\s*(\d{1,2}):(\d{2})$", k).try_cast("int") for k in (1, 2)]
    today = F.date_trunc("day", at) + F.make_dt_interval(hours=clock[0], mins=clock[1])
    today = F.when((clock[0] < 24) & (clock[1] < 60), F.when(today > at + F.make_dt_interval(mins=F.lit(5)), today - F.make_dt_interval(days=F.lit(1))).otherwise(today))
    return (
        F.when(ago("分钟前").isNotNull(), at - F.make_dt_interval(mins=ago("分钟前")))
        .when(ago("小时前").isNotNull(), at - F.make_dt_interval(hours=ago("小时前")))
        .when(ago("天前").isNotNull(), at - F.make_dt_interval(days=ago("天前")))
        .when(F.contains(text, F.lit("刚刚")), at)
        .when(F.contains(text, F.lit("昨天")), at - F.make_dt_interval(days=F.lit(1)))
        .when(clock[0].isNotNull(), today)
        .otherwise(month_day(plain, now))
    )


def month_day(text: Column, now: datetime) -> Column:
    """A month and day without a year (or with one that counts for nothing): this year's, or last year's if over two days ahead."""
    month, day = (F.regexp_extract(text, r"^(?:\d{4}年\s*)?(\d{1,2})月(\d{1,2})日$", k) for k in (1, 2))
    of = lambda year: F.try_to_timestamp(F.concat(F.lit(f"{year}-"), month, F.lit("-"), day, F.lit(" +0000")), F.lit("yyyy-M-d xx"))
    return F.when(month != "", F.when(of(now.year) > F.lit(now) + F.make_dt_interval(days=F.lit(2)), of(now.year - 1)).otherwise(of(now.year)))


# Zone names that feeds use, as offsets.
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "CET": "+0100", "CEST": "+0200", "EST": "-0500", "EDT": "-0400", "PST": "-0800", "PDT": "-0700",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "BST": "+0100", "JST": "+0900",
}
#: How a date looks, and the forms that such a one may have, the zone's offset behind them.
FORMS = {
    r"^\d{4}-\d{2}-\d{2}T": ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]xx", "yyyy-MM-dd'T'HH:mmxx"),
    r"^\d{4}-\d{2}-\d{2} ": ("yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]xx", "yyyy-MM-dd HH:mmxx", "yyyy-MM-dd h:mm:ssaxx", "yyyy-MM-dd h:mm[:ss] axx"),
    r"^\d{4}-": ("yyyy-M-d[ HH:mm[:ss]]xx",),
    r"^\d{4}/": ("yyyy/M/d[ HH:mm[:ss]]xx",),
    r"^\d{4}\.": ("yyyy.M.d[ HH:mm[:ss]]xx",),
    r"^\d{8}": ("yyyyMMdd['T'HHmmss]xx",),
    r"^\d+/\d+/": ("M/d/yyyy[ HH:mm[:ss]]xx", "M/d/yyyy h:mm[:ss] axx", "d/M/yyyy[ HH:mm[:ss]]xx"),
    r"^\d+[ -][A-Za-z]{3}[ -]": ("d MMM yyyy[ HH:mm[:ss]]xx", "d MMM yyyy h:mm[:ss] axx", "d-MMM-yyyy[ HH:mm[:ss]]xx"),
    r"^\d+ [A-Za-z]": ("d MMMM yyyy[ HH:mm[:ss]]xx", "d MMMM yyyy h:mm[:ss] axx"),
    r"^[A-Za-z]{3} \d": ("MMM d, yyyy[ HH:mm[:ss]]xx", "MMM d yyyy[ HH:mm[:ss]]xx", "MMM d, yyyy h:mm[:ss] axx", "MMM d yyyy h:mm[:ss] axx", "MMM d HH:mm:ss yyyyxx"),
    r"^[A-Za-z]": ("MMMM d, yyyy[ HH:mm[:ss]]xx", "MMMM d yyyy[ HH:mm[:ss]]xx", "MMMM d, yyyy h:mm[:ss] axx", "MMMM d yyyy h:mm[:ss] axx"),
}


def written_date(text: Column) -> Column:
    """A date as feeds write it, in any of FORMS, UTC where no zone is told; null for anything else. Only the forms that it looks like are tried."""
    offsets = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))

    def whole(plain: Column) -> Column:
        name = F.regexp_extract(plain, r"(?<![A-Za-z])([A-Z]{1,4})$", 1)
        shift = F.replace(F.regexp_extract(plain, r"[0-9]\s?([+-]\d{2}:?\d{2})$", 1), F.lit(":"), F.lit(""))
        offset = F.coalesce(F.nullif(shift, F.lit("")), F.element_at(offsets, name))
        bare = F.regexp_replace(plain, r"\s?([A-Z]{1,4}|[+-]\d{2}:?\d{2})$", "")
        return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(plain, F.lit("+0000"))).otherwise(let(offset, lambda o: F.when(o.isNull(), F.concat(plain, F.lit("+0000"))).otherwise(F.concat(bare, o))))

    day = r"^(?:[A-Za-z]{3,9},\s*|(?i:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?\s+))"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(stripped(text), day, ""), r"\s+", " "), r"(?<=\d)(st|nd|rd|th)\b|(?<=[A-Za-z]{3})\.(?= \d)", "")

    def parsed(w: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("timestamp"))
        for look, forms in FORMS.items():
            out = out.when(w.rlike(look), F.coalesce(*(F.try_to_timestamp(w, F.lit(p)) for p in forms)))
        return out

    return let(let(plain, whole), parsed)


def any_date(text: Column, now: datetime) -> Column:
    """A time in whatever form: a number of seconds or milliseconds, a relative time, a written date; null for anything else."""

    def read(plain: Column) -> Column:
        twelve = F.regexp_extract(plain, r"(\d{4}-\d{2}-\d{2}\s+\d{1,2}:\d{2}:\d{2}[AP]M)\s+UTC", 1)
        written = let(F.coalesce(F.nullif(twelve, F.lit("")), plain), written_date)
        # Only texts with Chinese letters, or a bare time of day, tell a relative time.
        relative = plain.rlike(r"[\x{4e00}-\x{9fff}]|^\s*\d{1,2}:\d{2}$")
        return F.when(plain.rlike(r"^\d{9,}$"), unix_time(plain)).when(relative, F.coalesce(relative_time_zh(plain, now), written)).otherwise(written)

    return let(F.regexp_replace(stripped(text), r"^\$D", ""), read)


def epoch_or_date(text: Column, now: datetime) -> Column:
    """Any plain number counts as a time since 1970, all else as `any_date` says."""
    return F.when(stripped(text).rlike(r"^\d+(\.\d+)?$"), unix_time(stripped(text))).otherwise(any_date(text, now))


def credible(at: Column, now: datetime) -> Column:
    """The time, if it lies between 2013 and now."""
    return F.when((at >= F.timestamp_seconds(F.lit(1356998400))) & (at <= F.lit(now)), at)


def note_id_time(note_id: Column, now: datetime) -> Column:
    """The time that the first eight hex digits of a note's id tell, if credible."""
    head = F.regexp_extract(stripped(note_id), "^([0-9a-fA-F]{8})", 1)
    return credible(unix_time(F.when(head != "", F.conv(head, 16, 10))), now)


def iso_text(at: Column) -> Column:
    """UTC as text with a Z, microseconds only where there are some."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.concat(F.regexp_replace(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("Z"))
