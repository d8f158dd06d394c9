"""Quality rules: text statistics, base limits, and a decision list learned from labels.

Statistics come from whole texts, one row a document. Sequential covering
grows a conjunction of thresholds on two thirds of the labelled rows that no
rule covers yet, prunes it on the last third, keeps it if it is precise enough
there, and goes on. The list ends up as one ordered Spark expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, byte_slices, split_words

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bang long, n_distinct long"
#: What rules may test. Shares are of zero where the whole is empty.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "bang_share": "n_bang / word_chars",
    "distinct_share": "n_distinct / n_words",
}
#: Labelled rows that are learned from at most: those with the least id hash.
SAMPLE_ROWS = 20_000


def repeated_words(split: Words, codes: np.ndarray, width: int = 3) -> np.ndarray:
    """For each text, how many of its words lie in a run of `width` words that it has twice or more."""
    n, owner = len(codes), np.repeat(np.arange(len(split.counts)), split.counts)
    starts = np.arange(max(0, n - width + 1))
    starts = starts[owner[starts] == owner[starts + width - 1]]
    # Ranks stand for what was seen so far, so equal keys mean equal words of one text, with no hash.
    key = owner[starts]
    spread = int(codes.max()) + 1 if n else 1
    bound = len(split.counts) + 1
    for k in range(width):
        if bound * spread >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            bound = len(starts) + 1
        key = key * spread + codes[starts + k]
        bound *= spread
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    same = key[order][1:] == key[order][:-1]
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[starts[again] + k] = True
    return np.bincount(owner[covered], minlength=len(split.counts))


def _distinct(split: Words, codes: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(split.counts)), split.counts)
    pairs = np.unique(owner * (int(codes.max()) + 1 if len(codes) else 1) + codes)
    return np.bincount(pairs // (int(codes.max()) + 1 if len(codes) else 1), minlength=len(split.counts))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, STATISTICS) of every row's whole text; a null text counts as empty.

    text_key: Spark's xxhash64 of the text as it stands. n_words, word_chars: words and their code points. n_symbols: characters of
    `[#*$%&|<>]`. n_dup_lines: lines with a word that equal an earlier line.
    n_repeat_words: words in 3-word runs found twice or more. n_lines: lines
    with a word. n_upper, n_bang: A-Z and `!`. n_distinct: distinct words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                split = split_words(part.column("text"))
                codes = split.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                chars = np.concatenate([[0], np.cumsum(pc.utf8_length(split.words).to_numpy(zero_copy_only=False))])
                lines, copies, symbols, upper, bang = [], [], [], [], []
                for text in pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist():
                    real = [x for x in text.split(b"\n") if x.strip()]
                    lines.append(len(real))
                    copies.append(len(real) - len(set(real)))
                    symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
                    upper.append(len(text) - len(text.translate(None, UPPER)))
                    bang.append(text.count(b"!"))
                columns = [split.counts, chars[split.offsets[1:]] - chars[split.offsets[:-1]], symbols, copies, repeated_words(split, codes), lines, upper, bang, _distinct(split, codes)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_key"), *(pa.array(c, pa.int64()) for c in columns)], names)

    names = ["id", "text_key", *(x.split()[0] for x in STATISTICS.split(", "))]
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(run, f"id {kind}, text_key long, {STATISTICS}")


def base_failed() -> Column:
    """Under 50 words, or over half of the words in repeated runs."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def holds(self, rows: np.ndarray) -> np.ndarray:
        values = rows[:, list(FEATURES).index(self.feature)]
        return values > self.limit if self.above else values <= self.limit

    def column(self) -> Column:
        value = feature(self.feature)
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rows for which all conditions hold are rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, rows: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(rows) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def feature(name: str) -> Column:
    return F.coalesce(F.expr(f"try_divide({FEATURES[name].replace(' / ', ', ')})") if "/" in FEATURES[name] else F.col(name), F.lit(0)).cast("double")


def _grow(rows: np.ndarray, bad: np.ndarray, most: int = 3) -> Rule | None:
    """Adds the condition of greatest information gain until no good row is covered."""
    inside, conditions = np.ones(len(rows), bool), []
    while len(conditions) < most and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, chosen = 1e-9, None
        for k, name in enumerate(FEATURES):
            values = np.unique(np.quantile(rows[inside, k], np.linspace(0, 1, 101)))
            for limit in (values[1:] + values[:-1]) / 2:
                high = rows[inside, k] > limit
                for above, hit in ((True, high), (False, ~high)):
                    q, m = (hit & bad[inside]).sum(), (hit & ~bad[inside]).sum()
                    if q and (gain := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > best:
                        best, chosen = gain, Condition(name, above, float(limit))
        if chosen is None:
            break
        conditions.append(chosen)
        inside &= chosen.holds(rows)
    return Rule(tuple(conditions)) if conditions else None


def _worth(rule: Rule, rows: np.ndarray, bad: np.ndarray) -> float:
    hit = rule.holds(rows)
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return float(p - n) / max(1, p + n)


def _pruned(rule: Rule, rows: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest leading part of the rule that does best on rows it wasn't grown on."""
    return max((Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)), key=lambda r: _worth(r, rows, bad))


def cover(rows: np.ndarray, bad: np.ndarray, draw: np.ndarray, precision: float = 0.95, least: int = 5, most: int = 12) -> list[Rule]:
    """An ordered list of rules that reject bad rows: each is right for `precision` of at least `least` bad rows."""
    rules: list[Rule] = []
    left = np.ones(len(rows), bool)
    grow = draw % 3 != 0
    while len(rules) < most and (left & bad & grow).any() and (left & bad & ~grow).any():
        rule = _grow(rows[left & grow], bad[left & grow])
        if rule is None:
            break
        rule = _pruned(rule, rows[left & ~grow], bad[left & ~grow])
        hit = rule.holds(rows) & left
        p, all_, late = (hit & bad).sum(), hit.sum(), hit & ~grow
        if p < least or p < precision * all_ or (late & bad).sum() < precision * late.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", hold_out: int = 2) -> list[Rule]:
    """The decision list from labelled statistics of rows that pass the base limits.

    Rows whose id's crc32 modulo 4 is `hold_out` are left for tests; of the
    others SAMPLE_ROWS take part at most. Null ids and labels teach nothing;
    without bad labels the list is empty.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & (F.crc32(F.col("id").cast("string")) % 4 != hold_out))
    # An id with both labels is bad; of an id's rows the one with the least statistics counts.
    chosen = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    rows = stats.where(~base_failed()).join(F.broadcast(chosen), "id").select("id", "label", F.struct(*(feature(x).alias(x) for x in FEATURES)).alias("x"))
    rows = rows.groupBy("id", "label").agg(F.min("x").alias("x")).select("label", F.xxhash64("id").alias("draw"), "x.*")
    table = rows.orderBy("draw", *FEATURES).toPandas()
    if not len(table):
        return []
    return cover(table[list(FEATURES)].to_numpy(float), table["label"].to_numpy() == 0, table["draw"].to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule of the list, tried in order, rejects."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        hit = rule.conditions[0].column()
        for c in rule.conditions[1:]:
            hit = hit & c.column()
        out = out.when(hit, F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, text_key, statistics, base_failed, kept) for every row.

    kept is false where the base limits fail and else the decision list's
    verdict. A null or empty text has no words and so fails. Null ids and
    repeated rows are judged by their texts like any other.
    """
    from .shared import written

    stats = written(statistics(docs, id_col, text_col))
    rules = learn(stats, labels, id_col, label_col)
    return stats.select(F.col("id").alias(id_col), "text_key", *(x.split()[0] for x in STATISTICS.split(", ")), base_failed().alias("base_failed"), verdict(rules).alias("kept"))
