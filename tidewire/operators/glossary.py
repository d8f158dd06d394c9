"""Repairs of translated titles: fixed ones for names that translators get wrong, and those of a glossary."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import stripped


class Repair(NamedTuple):
    """Where the original holds `guard` (always, if there is none), `bad` becomes `good` in the translation."""

    bad: str
    good: str
    guard: str | None = None


# What the original must hold (as a pattern), what it may not, and what is put right then, in this order.
NAMED = [
    (r"(?i)\bCodex\b", None, [("法典", "Codex")]),
    (r"(?i)\bBug Bounty\b", None, [("错误赏金", "漏洞悬赏"), ("Bug 赏金", "漏洞悬赏")]),
    (r"(?i)\bBio Bug Bounty\b", None, [("生物漏洞悬赏", "生物安全漏洞悬赏")]),
    (r"(?i)\brepositor(?:y|ies)\b", None, [("存储库", "代码仓库")]),
    (r"(?i)\bdesktop app\b", None, [("桌面应用程序", "桌面应用")]),
    (r"(?i)\btransformers?\b", r"(?i)\b(movie|film|trailer|hasbro|toy)\b", [("变形金刚", "Transformer")]),
    (r"(?i)\bHugging\s*Face\b", None, [("拥抱脸", "Hugging Face"), ("抱抱脸", "Hugging Face")]),
    (r"(?i)\bOpenAI\b", None, [("开放人工智能", "OpenAI")]),
    (r"(?i)\bAnthropic\b", None, [("人择", "Anthropic"), ("人类学公司", "Anthropic")]),
    (r"\bThe Information\b", None, [("《信息》", "The Information"), ("信息报", "The Information")]),
    (r"\bGemini\b", None, [("双子座", "Gemini")]),
    (r"(?i)\bLlama\b", None, [("骆驼", "Llama"), ("羊驼", "Llama")]),
    (r"(?i)\bCopilot\b", None, [("副驾驶", "Copilot")]),
    (r"\bCursor\b", None, [("光标", "Cursor")]),
    (r"\bPerplexity\b", None, [("困惑", "Perplexity")]),
]


def read_glossary(text: str) -> tuple[list[str], list[Repair]]:
    """Terms to be kept as they are, and repairs (`bad => good @guard`, the guard optional), of a glossary's lines; `#` begins a remark."""
    terms, repairs = [], []
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("#"):
            continue
        bad, arrow, rest = (x.strip() for x in line.partition("=>"))
        if not arrow:
            terms.append(line)
            continue
        good, at, guard = rest.rpartition("@") if "@" in rest else (rest, "", "")
        if bad and good.strip():
            repairs.append(Repair(bad, good.strip(), guard.strip() or None))
    return terms, repairs


def repaired_title(original: Column, translated: Column, repairs: list[Repair] = ()) -> Column:
    """The translation with all repairs done, the fixed ones first, each over what the ones before have left.

    The glossary is a setting, so it goes along as one array that each title
    folds over, however many repairs there are; the plan doesn't grow with it.
    Where a repair puts in ASCII, quotation marks right around it go.
    """
    source, out = F.coalesce(original, F.lit("")), stripped(F.coalesce(translated, F.lit("")))
    fixed = F.array(*(F.struct(F.lit(has).alias("has"), F.lit(lacks).cast("string").alias("lacks"), F.lit(bad).alias("bad"), F.lit(good).alias("good")) for has, lacks, pairs in NAMED for bad, good in pairs))
    out = F.aggregate(fixed, out, lambda t, r: F.when(F.contains(t, r["bad"]) & F.regexp_like(source, r["has"]) & ~F.coalesce(F.regexp_like(source, r["lacks"]), F.lit(False)), F.replace(t, r["bad"], r["good"])).otherwise(t))
    if not repairs:
        return out
    own = F.array(*(F.struct(F.lit(r.bad).alias("bad"), F.lit(r.good).alias("good"), F.lit(r.guard and r.guard.lower()).cast("string").alias("guard"), F.lit(r.good.isascii()).alias("plain")) for r in repairs))

    def step(t: Column, r: Column) -> Column:
        done = F.replace(t, r["bad"], r["good"])
        bare = F.regexp_replace(done, F.concat(F.lit("《(\\Q"), r["good"], F.lit("\\E[^《》]*)》")), F.lit("$1"))
        return F.when(F.contains(t, r["bad"]) & (r["guard"].isNull() | F.contains(F.lower(source), r["guard"])), F.when(r["plain"], bare).otherwise(done)).otherwise(t)

    return F.aggregate(own, out, step)
