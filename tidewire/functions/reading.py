"""What readers see of an item: section, author, source signal, scores in percent, event and identity keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped
from .times import hours_between

# Sections by label, then by the first group of words in the item's text.
LABEL_SECTIONS = {
    "model_release": "models",
    "ai_product_update": "products",
    "agent_workflow": "products",
    "robotics": "products",
    "developer_tool": "devtools",
    "developer_tooling": "devtools",
    "infra_compute": "devtools",
    "research_paper": "research",
    "industry_business": "industry",
}
SECTION_WORDS = {
    "research": r"paper|arxiv|research|benchmark|eval|dataset|lmsys|rdi|berkeley|huggingface daily papers|论文|研究|基准|评测|数据集|训练|k-means|speculative decoding",
    "models": r"gpt[-\s]?\d|claude|gemini|grok|llama|qwen|deepseek|mistral|kimi\s?k\d|glm|gemma|模型|model|weights|权重|多模态|视频生成|diffusion|sora|seedance|llm|大模型",
    "devtools": r"github|cursor|codex|copilot|openrouter|api|sdk|mcp|cli|framework|inference|推理|开发者|开源|代码|编程|算力|芯片|nvidia|cloud|部署|benchmarking|token",
    "products": r"app|product|agent|workflow|siri|copilot|chatgpt|perplexity|runway|suno|支付宝|产品|应用|智能体|机器人|浏览器|搜索|助手|生成工具|办公|教育",
    "industry": r"funding|raised|ipo|acquire|acquisition|lawsuit|regulation|policy|white house|pentagon|nvidia|salesforce|meta|microsoft|融资|收购|上市|监管|政策|裁员|估值|债券|芯片|公司|行业|政府|五角大楼|白宫",
}
# Sites and words of sources that make an item a creator's or a community's.
CREATOR_SOURCE_WORDS = ["douyin", "xiaohongshu", "小红书", "抖音"]
COMMUNITY_SITES = ["hackernews", "zeli", "waytoagi", "followbuilders", "aibase"]
COMMUNITY_SOURCE_WORDS = ["hacker news", "hackernews", "hn algolia", "it之家", "36氪", "掘金", "readhub", "aibase", "公众号", "宝玉", "小互"]
# Source types by site.
TYPE_SITES = {
    "media": ["curated_media", "aibreakfast", "aihot"],
    "rss": ["opmlrss"],
    "community": ["waytoagi", "followbuilders", "hackernews", "zeli", "aibase"],
    "creator": ["tikhub_douyin", "tikhub_xiaohongshu"],
    "advanced": ["socialdata_x", "xapi", "agentmail"],
}
# How much a source signal counts when one item stands for an event; any other counts OTHER_PRIORITY.
SIGNAL_PRIORITY = {"官方更新": 100, "AI HOT精选": 90, "AIbase": 82, "Builders": 74, "抖音自媒体": 70, "小红书自媒体": 70, "OPML": 68, "HN热议": 62, "GitHub趋势": 62}
OTHER_PRIORITY = 50
# What the parts of an item's priority weigh, and the least of each grade.
PRIORITY_WEIGHTS = {"editorial": 0.3, "tier": 0.22, "score": 0.2, "freshness": 0.18, "signals": 0.1}
GRADES = {"A+": 92, "A": 82, "B": 70}
# Models whose name stands for an event, and punctuation that event texts are without.
MODEL_KEYS = r"(bitcpmcann|deepseekv\d+(?:pro)?|grokv\d+(?:medium)?|gemini\d+(?:\.\d+)?(?:flash|pro)?|gpt\d+(?:\.\d+)?|llama\d+)"
EVENT_PUNCTUATION = r"[，。、“”‘’：:；;！!？?（）()\[\]【】《》<>·.,/\\|_-]"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _holds(text: Column, words: list[str]) -> Column:
    """One regular expression for the whole list."""
    return text.rlike("|".join(words))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def channel(site: Column, source: Column) -> Column:
    """Where an aggregated item comes from: wechat, x, hn, rss, or null."""
    s = _text(source)
    return F.when(site == "aihot", F.when(F.contains(s, F.lit("公众号")), "wechat").when(s.rlike("^X[:：]"), "x").when(F.contains(s, F.lit("Hacker News")), "hn").when(s.rlike(r"(（RSS）|\(RSS\))\s*$"), "rss"))


def author(site: Column, source: Column) -> Column:
    """The @handle of a post's author; null for what is no post."""
    post = (site == "socialdata_x") | (channel(site, source) == "x")
    handle = F.regexp_extract(_text(source), "@([A-Za-z0-9_]+)", 1)
    return F.when(post & (handle != ""), F.concat(F.lit("@"), handle))


def author_display(site: Column, source: Column) -> Column:
    """The author's name as shown, without the channel's mark."""
    s = stripped(_text(source))
    bare = F.when(site == "socialdata_x", s).when(channel(site, source) == "x", stripped(F.regexp_replace(s, r"^X[:：]\s*", "")))
    return F.nullif(bare, F.lit(""))


def source_group(site: Column, source: Column, name: Column) -> Column:
    """creator, community or other, by the source alone."""
    via, site = channel(site, source), _text(site)
    words = F.lower(F.concat(_text(source), F.lit(" "), _text(name)))
    return (
        F.when(via == "wechat", "creator")
        .when(via == "hn", "community")
        .when(site.isin(TYPE_SITES["creator"]) | _holds(words, CREATOR_SOURCE_WORDS), "creator")
        .when(site.isin(COMMUNITY_SITES) | _holds(words, COMMUNITY_SOURCE_WORDS), "community")
        .otherwise("other")
    )


def haystack(*texts: Column, signals: Column | None = None) -> Column:
    """What free text is searched in: the texts that aren't empty and the signals, lower-cased."""
    parts = [F.nullif(_text(t), F.lit("")) for t in texts]
    return F.lower(F.concat_ws(" ", *parts, *([signals] if signals is not None else [])))


def section(group: Column, label: Column, hay: Column) -> Column:
    """One section an item: by source group, then label, then the first group of words in its text, else "all"."""
    out = F.when(group != "other", group)
    for name, target in LABEL_SECTIONS.items():
        out = out.when(label == name, F.lit(target))
    for name, words in SECTION_WORDS.items():
        out = out.when(hay.rlike(words), F.lit(name))
    return out.otherwise("all")


# What makes an item a tool rather than a model, and sites, sources and words of the community; sites and words of sources under "hn".
TOOL_WORDS = r"skill|copilot|codex|cli|api|sdk|dashboard|workflow|tool|工具|助手|应用|插件|工作流|支付宝|浏览器|搜索"
GROUP_SITES = {"hn": ["hackernews", "zeli"], "creator": ["tikhub_douyin", "tikhub_xiaohongshu"], "community": ["waytoagi", "followbuilders", "aibase"]}
GROUP_SOURCE_WORDS = {"hn": r"hacker news|hackernews|hn algolia", "creator": r"douyin|xiaohongshu|小红书|抖音", "community": r"it之家|36氪|掘金|readhub|aibase|公众号|宝玉|小互|ayi"}
COMMUNITY_WORDS = r"waytoagi|社区|公众号|阿里|通义|千问|智谱|kimi|月之暗面|minimax|字节|火山|百度|腾讯|华为|蚂蚁|讯飞|国内|中文|开源中国|少数派|虎嗅"


def all_sections(site: Column, source: Column, name: Column, label: Column, hay: Column, content: Column) -> Column:
    """Every section that an item belongs to, "industry" where it is in no other; content is its text without the label."""
    sources = F.lower(F.concat(_text(source), F.lit(" "), _text(name)))
    labelled = lambda section: F.coalesce(label.isin([k for k, v in LABEL_SECTIONS.items() if v == section]), F.lit(False))
    group = lambda g: F.coalesce(site.isin(GROUP_SITES[g]), F.lit(False)) | sources.rlike(GROUP_SOURCE_WORDS[g])
    within = lambda s: labelled(s) | hay.rlike(SECTION_WORDS[s])
    tests = {
        "models": content.rlike(SECTION_WORDS["models"]) | (labelled("models") & ~hay.rlike(TOOL_WORDS)), "products": within("products"), "devtools": within("devtools"), "hn": group("hn"), "industry": within("industry"),
        "research": within("research"), "creator": group("creator"), "community": group("community") | hay.rlike(COMMUNITY_WORDS),
    }
    found = F.array_compact(F.array(*(F.when(test, s) for s, test in tests.items())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("industry")))


# What readers see of sections, in the order in which labels are given.
SECTION_NAMES = {"models": "模型", "products": "产品", "devtools": "开发者", "hn": "HN", "industry": "行业", "research": "研究", "creator": "自媒体", "community": "社区"}
SITE_TAGS = {"official_ai": "官方", "aihot": "AI HOT"}
SECTION_TAGS = {"models": "模型发布", "devtools": "开发者", "hn": "社区热议", "research": "研究", "creator": "自媒体", "community": "社区"}
IMPACTS = {"devtools": "开发者", "products": "产品", "industry": "企业 / 投资", "research": "研究", "models": "模型团队", "community": "社区", "hn": "社区"}
MANY_SOURCES, NO_IMPACT, NO_DAY, LABELS = "多源验证", "AI 观察者", "时间未知", 3
WEEKDAYS = ["星期日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六"]


def _labels(*labels: Column) -> Column:
    """The first few labels that are there, each once."""
    return F.slice(F.array_distinct(F.array_compact(F.array(*labels))), 1, LABELS)


def tags(sections: Column, site: Column, confirmed: Column, active: str = "hot") -> Column:
    """What an item is marked with in the list of the `active` section; confirmed: its event has other items."""
    of = [F.when(F.array_contains(sections, s), F.lit(t)) for s, t in SECTION_TAGS.items()]
    return _labels(F.lit(SECTION_NAMES.get(active)), F.when(confirmed, F.lit(MANY_SOURCES)), *(F.when(site == s, F.lit(t)) for s, t in SITE_TAGS.items()), *of)


def impacts(sections: Column) -> Column:
    """Whom an item of these sections concerns."""
    found = _labels(*(F.when(F.array_contains(sections, s), F.lit(t)) for s, t in IMPACTS.items()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_IMPACT)))


def day_label(at: Column, now: datetime, zone: str = "Asia/Shanghai") -> Column:
    """The local day, with its year unless that is the present one."""
    local, today = F.from_utc_timestamp(at, zone), F.from_utc_timestamp(F.lit(now), zone)
    return F.when(at.isNull(), NO_DAY).when(F.year(local) == F.year(today), F.date_format(local, "M月d日")).otherwise(F.date_format(local, "yyyy年M月d日"))


def weekday(at: Column, zone: str = "Asia/Shanghai") -> Column:
    """The local day of the week; empty for an unknown time."""
    return F.when(at.isNull(), "").otherwise(F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(F.from_utc_timestamp(at, zone))))


def timeline(published: Column, first_seen: Column, generated: datetime) -> Column:
    """Published, but first seen where published lies over ten minutes after the snapshot."""
    late = published > F.lit(generated) + F.make_dt_interval(mins=F.lit(10))
    return F.when(late, F.coalesce(first_seen, published)).otherwise(F.coalesce(published, first_seen))


def event_text(title: Column) -> Column:
    """Lower-cased, without URLs, blanks and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(_text(title)), r"https?://\S+", ""), r"[\s　]+", ""), EVENT_PUNCTUATION, "")


def event_key(title: Column) -> Column:
    """What items of one event share: a quoted book title, a model's name, else the first 34 characters."""
    book, plain = F.regexp_extract(_text(title), "《([^》]{4,40})》", 1), event_text(title)
    model = F.regexp_extract(plain, MODEL_KEYS, 1)
    return F.when(book != "", F.concat(F.lit("book:"), F.left(event_text(book), F.lit(36)))).when(model != "", F.concat(F.lit("entity:"), model)).otherwise(F.concat(F.lit("title:"), F.left(plain, F.lit(34))))


def identity_keys(id_: Column, title: Column, url: Column) -> Column:
    """Keys by any of which an item is known again: URL, id, event and title."""
    of = lambda name, value, there: F.when(there, F.concat(F.lit(f"{name}:"), value))
    some = lambda c: _text(c) != ""
    return F.array_distinct(F.array_compact(F.array(of("url", _text(url), some(url)), of("id", _text(id_), some(id_)), of("event", event_key(title), some(title)), of("title", F.left(event_text(title), F.lit(34)), some(title)))))


def percent(value: Column) -> Column:
    """0 to 1 as percent, what is greater as it stands, rounded half up; 0 for null, NaN and what isn't positive."""
    x = value.cast("double")
    return F.coalesce(F.when(F.isnan(x) | (x <= 0), 0).when(x <= 1, half_up(x * 100)).when(x < float("inf"), half_up(x)), F.lit(0))


def capped_percent(value: Column) -> Column:
    return F.least(F.lit(100), percent(value))


def priority_parts(site: Column, rank: Column, score: Column, outside: Column, at: Column, n_signals: Column, now: datetime) -> dict[str, Column]:
    """editorial, tier, score, freshness and signals of an item in percent."""
    own, given = percent(score), capped_percent(outside)
    editorial = F.when(given > 0, given).when(site == "official_ai", 90).when(site == "aihot", 78).when(own > 0, F.greatest(F.lit(45), half_up(own * F.lit(0.72)))).otherwise(36)
    tier = F.when(site == "official_ai", 100).when(site == "aihot", 90).when(rank.isNull(), 38).otherwise(F.greatest(F.lit(28), F.least(F.lit(86), 86 - rank * 9)))
    age = hours_between(F.lit(now), at)
    fresh = F.when(age < 0, 100).otherwise(half_up(F.pow(F.lit(0.5), age / 48.0) * 100))
    return {"editorial": editorial, "tier": tier, "score": own, "freshness": F.coalesce(fresh, F.lit(100)), "signals": F.least(F.lit(100), F.coalesce(n_signals, F.lit(0)) * 18)}


def priority(parts: dict[str, Column]) -> Column:
    first, *rest = (parts[k] * F.lit(w) for k, w in PRIORITY_WEIGHTS.items())
    return half_up(sum(rest, first))


def high_priority(score: Column, priority_: Column, site: Column) -> Column:
    return (score >= 75) | (priority_ >= 82) | F.coalesce(site.isin("official_ai", "aihot"), F.lit(False))


def grade(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, least in GRADES.items():
        out = out.when(score >= least, F.lit(name))
    return out.otherwise("C")


def curated(site: Column, tier: Column) -> Column:
    return F.coalesce(site.isin("official_ai", "aihot"), F.lit(False)) | F.coalesce(tier.isin("official", "curated"), F.lit(False))


def source_type(site: Column, tier: Column) -> Column:
    s, t = _text(site), _text(tier)
    out = F.when((s == "official_ai") | (t == "official"), "official").when(s.isin(TYPE_SITES["media"]), "media").when(s.isin(TYPE_SITES["rss"]) | (t == "user_opml"), "rss")
    for name in ("community", "creator", "advanced"):
        out = out.when(s.isin(TYPE_SITES[name]), F.lit(name))
    return out.otherwise("aggregate")


def source_signal(name: Column, source: Column) -> Column:
    """The label of where an item was seen; items of one event with two of them are confirmed."""
    site, src = _text(name), _text(source)
    hay = F.lower(F.concat(site, F.lit(" "), src))
    return (
        F.when(site == "AI HOT", "AI HOT精选")
        .when(hay.rlike("hackernews|hacker news"), "HN热议")
        .when(F.contains(hay, F.lit("github")), "GitHub趋势")
        .when(site == "Official AI Updates", "官方更新")
        .when(site == "Follow Builders", "Builders")
        .when(F.contains(hay, F.lit("tikhub douyin")), "抖音自媒体")
        .when(F.contains(hay, F.lit("tikhub xiaohongshu")), "小红书自媒体")
        .when(site == "AIbase", "AIbase")
        .when(site == "OPML RSS", "OPML")
        .when(site != "", site)
        .otherwise("来源")
    )


def source_priority(signal: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, value in SIGNAL_PRIORITY.items():
        out = out.when(signal == name, value)
    return out.otherwise(OTHER_PRIORITY)
