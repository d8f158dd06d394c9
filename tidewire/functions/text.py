"""Text functions as built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import (
    AUDIT_STOPWORDS,
    DISCUSSION_KEYWORDS,
    EMAIL_PATTERN,
    MODEL_PATTERN,
    OVERLAP_DROPPED,
    OVERLAP_ENTITIES,
    OVERLAP_SUFFIXES,
    SECRET_PATTERN,
    TITLE_STOPWORDS,
    VENDOR_ALIASES,
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What `body` makes of a value that is worked out once, however often it is used; plans stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def stripped(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    """Each run of Unicode blanks as one space, none at the ends."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def first_non_empty(*texts: Column) -> Column:
    """The first text that isn't blank, stripped; empty if all are."""
    return F.coalesce(*(F.nullif(stripped(t), F.lit("")) for t in texts), F.lit(""))


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{4e00}-\x{9fff}]")


def mostly_english(text: Column) -> Column:
    """No CJK, and letters are at least six and a quarter of the length, blanks at the ends aside."""
    text = stripped(text)
    return ~has_cjk(text) & (F.regexp_count(text, F.lit("[A-Za-z]")) >= F.greatest(F.lit(6), F.floor(F.length(text) / 4)))


def cut(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last of them an ellipsis where something is cut."""
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.left(text, F.lit(limit - 1)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)


def redacted(text: Column) -> Column:
    """Mail addresses and secrets replaced."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL_PATTERN, "[redacted-email]"), SECRET_PATTERN, "[redacted-secret]")


def snippet(text: Column, limit: int = 240) -> Column:
    return cut(redacted(squeezed(text)), limit)


def contained(text: Column, words: list[str]) -> Column:
    """Those of the words that occur in the text, sorted."""
    return F.array_sort(F.filter(words_of(words), lambda k: F.contains(text, k)))


def contains_any(text: Column, words: list[str]) -> Column:
    """Some word occurs in the text: one compiled alternation, one pass."""
    return text.rlike("|".join(re.escape(w) for w in words))


def bounded(text: Column, words: list[str]) -> Column:
    """Some word occurs with no letter or digit beside it."""
    return text.rlike(rf"(?i)(?<![a-z0-9])({'|'.join(words)})(?![a-z0-9])")


def title_tokens(title: Column) -> Column:
    """Distinct lower-case runs of letters and digits and CJK runs, of two characters or more, without stop words and URLs."""
    plain = F.regexp_replace(F.lower(title), r"https?://\S+", " ")
    found = F.regexp_extract_all(plain, F.lit(r"([a-z0-9]+|[\x{4e00}-\x{9fff}]{2,})"), 0)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(TITLE_STOPWORDS)))


def story_title(title: Column, bilingual: Column | None = None) -> Column:
    """Lower-cased, blanks squeezed, the half after a slash dropped where the title is bilingual."""
    low = F.lower(stripped(title))
    if bilingual is not None:
        low = F.when(F.coalesce(bilingual, F.lit("")) != "", F.regexp_replace(low, r"(?U)\s*/\s*.+$", "")).otherwise(low)
    return F.regexp_replace(low, r"(?U)\s+", " ")


def mergeable(title: Column) -> Column:
    return (F.size(title_tokens(title)) >= 4) & (F.length(stripped(title)) >= 18)


def vendors(title: Column) -> Column:
    low = F.lower(title)
    names = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(a)), F.lit(v)) for a, v in VENDOR_ALIASES.items())))
    return F.array_sort(F.array_distinct(names))


def models(title: Column) -> Column:
    found = F.regexp_extract_all(F.lower(title), F.lit(MODEL_PATTERN), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, r"\s+", "-"))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


MOJIBAKE_SIGNS = r"[Ãâåèæïðçé\x{80}-\x{9f}]"
# What Windows puts at 0x80 to 0x9f, and the same places in Latin-1.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
LATIN = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


def repaired(text: Column) -> Column:
    """Stripped; where UTF-8 was read as Latin-1 or Windows-1252, read again as it should be."""
    plain = stripped(text)
    again = lambda t: F.try_validate_utf8(F.encode(t, "ISO-8859-1").cast("string"))
    latin = F.when(plain.rlike(r"^[\x{00}-\x{ff}]*$"), again(plain))
    windows = F.when(plain.rlike(rf"^[\x{{00}}-\x{{7f}}\x{{a0}}-\x{{ff}}{WINDOWS}]*$"), again(F.translate(plain, WINDOWS, LATIN)))
    changed = lambda t: F.when(t != plain, t)
    return F.when(plain.rlike(MOJIBAKE_SIGNS), F.coalesce(changed(latin), changed(windows), plain)).otherwise(plain)


def garbled(text: Column) -> Column:
    """Shows signs of a wrong encoding."""
    return F.coalesce(text.rlike("(Ã|Â|â€|æ·|\ufffd)"), F.lit(False))


def allowed_entry(keywords: Column, strict: Column, title: Column, link: Column, feed: Column) -> Column:
    """Some of a feed's comma-separated keywords is in the title (unless strict: title, link or feed's name); no keywords allow all."""
    words = F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), ","), lambda k: F.lower(stripped(k))), lambda k: k != "")
    wide = F.lower(F.concat_ws(" ", title, link, feed))
    hay = F.when(F.coalesce(strict, F.lit(False)), F.lower(title)).otherwise(wide)
    return (F.size(words) == 0) | F.exists(words, lambda k: F.contains(hay, k))


def sender_domain(address: Column) -> Column:
    """The domain of a sender, never the address."""
    at = F.coalesce(F.nullif(F.regexp_extract(address, "<([^>]*)>", 1), F.lit("")), stripped(address))
    return F.nullif(F.lower(stripped(F.when(F.contains(at, F.lit("@")), F.substring_index(at, "@", -1)))), F.lit(""))


def allowed_domain(domain: Column, allowed: list[str]) -> Column:
    """The domain is one of the allowed ones or under one; an empty list allows all."""
    if not allowed:
        return F.lit(True)
    tests = [(domain == a) | domain.endswith("." + a) for a in allowed]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def placeholder_title(title: Column) -> Column:
    """Says nothing but that there is something to read."""
    t = stripped(F.coalesce(title, F.lit("")))
    return (t == "") | F.contains(t, F.lit("详情见官方介绍")) | t.isin("原文链接", "查看详情", "点击查看", "详情")


def generic_title(title: Column) -> Column:
    return placeholder_title(title) | F.coalesce(stripped(title).rlike(r"\(AI资讯\)\s*$"), F.lit(False))


def keyword_score(title: Column) -> Column:
    """A third for each keyword that stands by itself in the title, 1 at most."""
    low = F.lower(title)
    hits = sum((low.rlike(rf"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])").cast("int") for k in DISCUSSION_KEYWORDS), F.lit(0))
    return F.least(F.lit(1.0), hits / 3)


def displayed_source(site: Column, source: Column, host: Column) -> Column:
    """The source, or the host where it is blank or only repeats the site."""
    src, bare = stripped(F.coalesce(source, F.lit(""))), F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))
    return F.when(src == "", F.coalesce(bare, F.lit("未分区"))).when((site == "buzzing") & (F.lower(src) == "buzzing"), F.coalesce(bare, src)).otherwise(src)


def overlap_title(title: Column) -> Column:
    """As titles are compared between sources: without a source's suffix, labels in brackets, years, punctuation and filler words."""
    low = F.lower(stripped(F.coalesce(title, F.lit(""))))
    last = F.regexp_replace(F.regexp_extract(low, r"(?s)^.*\s[—–-]\s+(.*)$", 1), r"^[ .]+|[ .]+$", "")
    low = F.when(last.isin(OVERLAP_SUFFIXES), F.regexp_replace(low, r"(?s)\s+[—–-]\s+((?!\s[—–-]\s).)*$", "")).otherwise(low)
    low = F.regexp_replace(F.regexp_replace(low, r"\[(exclusive|breaking|update|news)\]", " "), r"\b20\d{2}\b", " ")
    words = F.split(F.regexp_replace(low, r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(OVERLAP_DROPPED)), " ")


def overlap_entities(normal: Column) -> Column:
    return F.array_intersect(words_of(OVERLAP_ENTITIES), F.split(normal, " "))


def bigram_tokens(title: Column) -> Column:
    """Words of two characters or more, of CJK runs the pairs of neighbours (a single character stands for itself), for source audits."""
    plain = F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "), " ")
    latin = F.filter(F.transform(plain, lambda c: F.regexp_replace(c, r"[\x{4e00}-\x{9fff}]", "")), lambda w: (F.length(w) > 1) & ~w.isin(AUDIT_STOPWORDS))
    runs = F.filter(F.transform(plain, lambda c: F.regexp_replace(c, "[a-z0-9]", "")), lambda w: w != "")
    pairs = F.flatten(F.transform(runs, lambda t: F.when(F.length(t) == 1, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 1)), lambda k: F.substring(t, k, F.lit(2))))))
    return F.array_distinct(F.concat(latin, pairs))


def reading_length(title: Column) -> Column:
    """Characters as an editor counts them: CJK ones, two for each word with a letter, one for each number."""
    tokens = F.regexp_extract_all(title, F.lit(r"([A-Za-z0-9.+-]+)"), 1)
    return F.regexp_count(title, F.lit(r"[\x{4e00}-\x{9fff}]")) + F.aggregate(tokens, F.lit(0), lambda n, t: n + F.when(t.rlike("[A-Za-z]"), 2).otherwise(1))


def needs_context(site: Column, tier: Column, title_zh: Column, title_en: Column) -> Column:
    """The title doesn't tell what it is about: short, a bare name, or with a year behind it. The first rule that fits decides."""
    site, tier, zh, en = (stripped(F.coalesce(c, F.lit(""))) for c in (site, tier, title_zh, title_en))
    shown = F.when(zh != "", zh).otherwise(en)
    year, wide = r"[(（]20\d{2}[)）]\s*$", F.lower(tier).isin("discussion", "aggregate", "community")
    return (
        F.when((F.lower(site) == "official_ai") | F.lower(tier).isin("official", "curated"), False)
        .when(wide & shown.rlike(year), True)
        .when(has_cjk(shown) & (F.length(shown) >= 12), False)
        .when(mostly_english(en) & (F.size(F.split(en, r"\s+")) <= 4), True)
        .otherwise(wide & (((shown != "") & (F.length(shown) < 18)) | en.rlike(year)))
    )


def clean_review(text: Column, limit: int = 60) -> Column:
    """A review for print: control characters out, stripped, cut."""
    return F.left(stripped(F.regexp_replace(text, r"[\x{00}-\x{1f}\x{7f}]", "")), F.lit(limit))


def percent_text(part: Column, whole: Column) -> Column:
    """A share with one decimal, a dash of nothing."""
    return F.when(whole == 0, "—").otherwise(F.concat(F.format_number(part * 100.0 / whole, 1), F.lit("%")))
