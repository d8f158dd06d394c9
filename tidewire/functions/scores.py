"""Relevance, source tiers and importance of items, as column expressions."""

from __future__ import annotations

from datetime import datetime
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as v
from .text import bounded, contained, contains_any, stripped
from .times import event_time, freshness, hours_between
from .urls import host_of


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain(*table.items()))), key), F.lit(default))


def unsafe(text: Column) -> Column:
    """Any hard pattern, or two of the softer ones: one mention alone is news."""
    soft = sum((text.rlike(f"(?i){p}").cast("int") for p in v.UNSAFE_PROMO_PATTERNS), F.lit(0))
    return text.rlike(f"(?i){'|'.join(v.UNSAFE_HARD_PATTERNS)}") | (soft >= 2)


def meaningful(text: Column) -> Column:
    strong = [k for k in v.AI_KEYWORDS if k not in v.BROAD_AI_TERMS]
    return bounded(text, [*v.MEANINGFUL_SIGNALS, "cursor"]) | contains_any(text, strong)


def broad(text: Column) -> Column:
    return contains_any(text, v.BROAD_AI_TERMS) | bounded(text, v.BROAD_SIGNALS)


def topic_label(text: Column, has_tech: Column) -> Column:
    """The first group with a word in the text."""
    out = F.when(F.lit(False), F.lit(""))
    for label, words in v.LABEL_KEYWORDS.items():
        out = out.when(contains_any(text, words), F.lit(label))
    return out.otherwise(F.when(has_tech, F.lit("ai_tech")).otherwise(F.lit("ai_general")))


def with_relevance(items: DataFrame) -> DataFrame:
    """Adds ai_is_related, ai_score, ai_label, ai_relevance_reason, ai_signals and ai_noise.

    items: site_id, site_name, source, title, url; nulls count as empty. Only
    the URL's host is read, never its path. The first branch that holds decides.
    """
    site, title, source, name, url = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("site_id", "title", "source", "site_name", "url"))
    text, head, origin = F.col("_text"), F.col("_head"), F.col("_origin")
    out = items.withColumns({
        "_site": site, "_head": F.lower(title), "_origin": F.lower(source),
        "_text": F.lower(F.concat_ws(" ", title, source, name, host_of(url))),
        "_prior": _lookup(v.SOURCE_PRIORS, site, 0.0),
    })
    out = out.withColumns({
        "_ai": F.array_sort(F.array_union(contained(text, v.AI_KEYWORDS), F.when(bounded(text, ["cursor"]), F.array(F.lit("cursor"))).otherwise(F.array().cast("array<string>")))),
        "_tech": contained(text, v.TECH_KEYWORDS),
        "_noise": F.concat(contained(text, v.NOISE_KEYWORDS), contained(text, v.COMMERCE_NOISE_KEYWORDS)),
        "_has_ai": meaningful(text), "_broad": broad(text), "_head_ai": meaningful(head), "_head_broad": broad(head),
        "_head_research": contains_any(head, v.RESEARCH_TERMS),
        "_trusted": contains_any(origin, v.CURATED_TRUSTED), "_research": contains_any(origin, v.CURATED_RESEARCH),
    })
    c = {k: F.col(f"_{k}") for k in ("site", "prior", "ai", "tech", "noise", "has_ai", "broad", "head_ai", "head_broad", "head_research", "trusted", "research")}
    has_tech = F.size(c["tech"]) > 0
    curated = c["site"] == "curated_media"
    in_scope = c["trusted"] | c["research"] | c["head_ai"] | (c["head_broad"] & has_tech)
    branch = (
        F.when(unsafe(text), "unsafe")
        .when(curated & c["research"] & ~(c["head_ai"] | c["head_research"]), "research_drop")
        .when(curated & ~in_scope, "scope_drop")
        .when(curated, "curated")
        .when(c["site"].isin(v.DEFAULT_KEEP_SITES), "default")
        .when(~(c["has_ai"] | (c["broad"] & has_tech)), "missing")
        .when(contains_any(text, v.COMMERCE_NOISE_KEYWORDS) & ~c["has_ai"], "commerce")
        .when(contains_any(text, v.NOISE_KEYWORDS) & ~c["has_ai"], "noise")
        .otherwise("kept")
    )
    n_ai, n_tech, n_noise = (F.size(c[k]) for k in ("ai", "tech", "noise"))
    step = lambda most, each, n: F.least(F.lit(most), F.lit(each) * n)
    curated_score = c["prior"] + F.when(c["trusted"], 0.58).otherwise(0.5) + step(0.12, 0.03, n_ai) + step(0.08, 0.02, n_tech)
    curated_score = F.when(c["research"], F.least(curated_score, F.lit(0.76))).otherwise(curated_score)
    curated_score = curated_score - F.when(~c["head_ai"], step(0.16, 0.04, n_noise)).otherwise(0.0)
    kept_score = c["prior"] + F.when(c["has_ai"], 0.52).otherwise(0.34) + step(0.18, 0.04, n_ai) + step(0.12, 0.03, n_tech) - step(0.18, 0.04, n_noise)
    is_ = lambda name: F.col("_branch") == name
    score = (
        F.when(is_("unsafe"), 0.0)
        .when(is_("research_drop"), 0.22)
        .when(is_("scope_drop"), c["prior"] + F.when(c["head_broad"], 0.28).otherwise(0.0))
        .when(is_("curated"), curated_score)
        .when(is_("default"), F.greatest(F.lit(v.KEEP_SCORE), c["prior"] + 0.72))
        .when(is_("missing"), c["prior"] + F.when(c["broad"], 0.32).otherwise(0.0) + F.when(has_tech, 0.08).otherwise(0.0))
        .when(is_("commerce") | is_("noise"), c["prior"] + 0.25)
        .otherwise(F.greatest(F.lit(v.KEEP_SCORE), kept_score))
    )
    topic = topic_label(text, has_tech)
    label = (
        F.when(is_("unsafe"), F.lit("unsafe_content"))
        .when(is_("research_drop") | is_("scope_drop"), F.lit("source_scope_drop"))
        .when(is_("curated") & (c["research"] | c["head_research"]), F.lit("research_paper"))
        .when(is_("curated") & contains_any(head, v.BUSINESS_TERMS), F.lit("industry_business"))
        .when(is_("missing"), F.lit("not_ai"))
        .when(is_("commerce"), F.lit("commerce_noise"))
        .when(is_("noise"), F.lit("noise"))
        .otherwise(topic)
    )
    # The reasons given to readers.
    reasons = {
        "unsafe": "unsafe_promotional_content",
        "research_drop": "curated_research_source_requires_research_or_ai_title_signal",
        "scope_drop": "curated_media_requires_ai_title_or_trusted_ai_feed",
        "curated": "curated_media_source_filter",
        "default": "trusted_ai_source_default_keep",
        "missing": "missing_meaningful_ai_signal",
        "commerce": "commerce_noise_without_strong_ai_signal",
        "noise": "noise_without_strong_ai_signal",
    }
    reason = _lookup(reasons, F.col("_branch"), "")
    reason = F.when(is_("kept"), F.when(c["has_ai"], F.lit("matched_ai_signal")).otherwise(F.lit("matched_broad_ai_plus_tech_signal"))).otherwise(reason)
    none = F.array().cast("array<string>")
    both = F.concat(c["ai"], c["tech"])
    signals = (
        F.when(is_("unsafe"), none)
        .when(is_("curated") & (F.size(both) == 0) & c["trusted"], F.array(origin))
        .when(is_("default"), F.when(n_ai > 0, c["ai"]).otherwise(F.array(c["site"])))
        .otherwise(both)
    )
    rounded = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
    out = out.withColumn("_branch", branch).withColumn("_raw", score)
    out = out.withColumns({
        "ai_is_related": is_("default") | is_("kept") | (is_("curated") & (F.col("_raw") >= v.KEEP_SCORE)),
        "ai_score": rounded, "ai_label": label, "ai_relevance_reason": reason, "ai_signals": signals,
        "ai_noise": F.when(is_("unsafe"), F.array(F.lit("unsafe_promotional_content"))).otherwise(c["noise"]),
    })
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def site_rank(site: Column) -> Column:
    """Rank of the site's tier, 9 for an unknown one; all subscribed feeds count as one site."""
    return _lookup({s: r for s, (_, r) in v.SITE_TIERS.items()}, _tier_site(site), 9)


def _tier_site(site: Column) -> Column:
    low = F.lower(stripped(F.coalesce(site, F.lit(""))))
    return F.when(low.startswith("opmlrss"), F.lit("opmlrss")).otherwise(low)


def with_tier(items: DataFrame) -> DataFrame:
    """Adds source_tier, source_tier_label and source_tier_rank; some channels of one site are official."""
    first = (F.col("site_id") == v.FIRST_PARTY_SITE) & stripped(F.col("source")).isin(v.FIRST_PARTY_SOURCES)
    first = F.coalesce(first, F.lit(False))
    tier = F.when(first, F.lit("official")).otherwise(_lookup({s: t for s, (t, _) in v.SITE_TIERS.items()}, _tier_site(F.col("site_id")), "other"))
    out = items.withColumns({"source_tier": tier, "source_tier_rank": F.when(first, 0).otherwise(site_rank(F.col("site_id")))})
    return out.withColumn("source_tier_label", _lookup(v.TIER_LABELS, F.col("source_tier"), v.TIER_LABELS["other"]))


def importance_parts(now: datetime, copies: Column | None = None) -> dict[str, Column]:
    """editorial, source_tier, ai_relevance, recency and story_heat of a scored, tiered item with event_time and aihot_score."""
    relevance = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ai_score"))), F.when(F.col("ai_is_related"), 1.0).otherwise(0.0))
    outside = F.col("aihot_score").cast("double")
    outside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(outside > 1, outside / 100).otherwise(outside)))
    editorial = (
        F.when(F.col("aihot_score").isNotNull(), outside)
        .when(F.col("site_id") == "official_ai", 0.9)
        .when(F.col("site_id") == "aihot", 0.78)
        .when(F.col("ai_is_related"), F.greatest(F.lit(0.45), relevance * 0.72))
        .otherwise(relevance * 0.6)
    )
    heat = F.least(F.lit(1.0), F.greatest(F.lit(0), (copies if copies is not None else F.lit(1)) - 1) / 4)
    return {
        "editorial": editorial,
        "source_tier": _lookup(v.TIER_IMPORTANCE, F.col("source_tier"), v.TIER_IMPORTANCE["other"]),
        "ai_relevance": relevance,
        "recency": freshness(F.col("event_time"), now),
        "story_heat": heat,
    }


#: What each part weighs.
WEIGHTS = {"editorial": 0.3, "source_tier": 0.22, "ai_relevance": 0.2, "recency": 0.18, "story_heat": 0.1}


def importance(now: datetime, copies: Column | None = None) -> Column:
    parts = importance_parts(now, copies)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)))), 4)


def story_category(score: Column, tier: Column, copies: Column) -> Column:
    return F.when(tier == "official", "official").when(copies >= 3, "multi_source").when(score >= 0.72, "industry").otherwise("watch")


def with_creator_ranking(items: DataFrame, now: datetime) -> DataFrame:
    """Adds engagement, heat, freshness bonus and hot score of items with creator_metrics (likes, comments, collects, shares)."""
    metric = lambda name: F.greatest(F.lit(0), F.coalesce(F.col(f"creator_metrics.{name}").cast("bigint"), F.lit(0)))
    engagement = metric("likes") + metric("comments") * 2.0 + metric("collects") * 1.5 + metric("shares") * 2.0
    scale = F.when(F.col("site_id") == "tikhub_xiaohongshu", 22.0).otherwise(20.0)
    heat = F.least(F.lit(100.0), scale * F.log10(F.lit(1.0) + engagement))
    age = hours_between(F.lit(now), event_time(F.col("site_id"), F.col("published_at"), F.col("first_seen_at")))
    bonus = F.when(age.between(0, 24), 15.0).otherwise(0.0)
    return items.withColumns({
        "creator_engagement_total": F.round(engagement, 1), "creator_heat_score": F.round(heat, 1), "creator_freshness_bonus": bonus,
        "creator_hot_score": F.round(F.least(F.lit(100.0), heat * 0.85 + bonus), 1),
    })
