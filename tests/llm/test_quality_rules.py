import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewire.llm import quality_rules as R

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_statistics_match_brute_force(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:60]
    texts = [t[:2500] for t in texts] + [None, "", " \n ", "a b c a b c", "a a a a", "a\na\n\na", "x\xa0y z", "é#*|<>é", "one\n two\n two", "a b c\x0bd a b c", "w " * 100_000]
    rows = [(k, t, -1) for k, t in enumerate(texts)] + [(None, "a b c a b c", 3), (3, texts[3], 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = sorted((str(r.id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in R.statistics(frame).collect())
    want = sorted((str(d), *(brute(t) if len(t or "") < 10_000 else (100_000, 100_000, 0, 0, 100_000))) for d, t, _ in rows)
    assert got == want


def test_wide_keys_fall_back_to_ranks():
    import pyarrow as pa

    split = R.split_words(pa.array(["a b c d a b c", "a b c", ""]))
    codes = split.words.dictionary_encode().indices.to_numpy().astype(np.int64)
    assert R.repeated_words(split, codes).tolist() == [6, 0, 0]
    assert R.repeated_words(split, codes * (1 << 40)).tolist() == [6, 0, 0]


def test_cover_finds_planted_rules_and_keeps_clean_rows():
    draw = np.random.default_rng(0)
    rows = draw.random((3000, len(R.FEATURES)))
    names = list(R.FEATURES)
    bad = (rows[:, names.index("symbol_share")] > 0.8) | ((rows[:, names.index("upper_share")] > 0.7) & (rows[:, names.index("bang_share")] > 0.5))
    rules = R.cover(rows, bad, draw.integers(0, 1 << 30, 3000))
    hit = np.logical_or.reduce([r.holds(rows) for r in rules])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()
    assert R.cover(rows, np.zeros(3000, bool), np.arange(3000)) == []


def test_expression_agrees_with_rules_and_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    stats = R.statistics(docs)
    rules = R.learn(stats, labels)
    table = stats.select("id", R.base_failed().alias("base"), *(R.feature(x).alias(f"f_{x}") for x in R.FEATURES), R.verdict(rules).alias("kept")).toPandas()
    hit = np.logical_or.reduce([r.holds(table[[f"f_{x}" for x in R.FEATURES]].to_numpy(float)) for r in rules] or [np.zeros(len(table), bool)])
    assert (table["kept"] == ~(hit | table["base"])).all()
    judged = R.judged(docs, labels).join(labels.where((F.crc32(F.col("doc_id").cast("string")) % 4 == 2)), "doc_id").where("not base_failed").toPandas()
    good, bad = judged[judged["quality"] == 1], judged[judged["quality"] == 0]
    assert good["kept"].mean() > 0.95 and bad["kept"].mean() < 0.4, (rules, good["kept"].mean(), bad["kept"].mean())


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 60, True), (2, None, False), (3, " ".join(f"w{k}" for k in range(60)), None)], "doc_id long, text string, kept boolean")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in R.judged(docs, none).collect()} == {1: False, 2: False, 3: True}
    odd = spark.createDataFrame([(1, None, 0), (None, 0, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert R.judged(docs, odd).count() == 3
    assert R.judged(docs.limit(0), odd).collect() == []


def test_verdicts_match_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rules = R.learn(R.statistics(docs), labels) + [R.Rule((R.Condition("upper_share", True, 0.4), R.Condition("bang_share", True, 0.01))), R.Rule((R.Condition("n_words", False, 60.0),))]
    texts = [r.text for r in docs.orderBy("doc_id").limit(150).collect()] + ["WOW! " * 3 + " ".join(f"LOUD{k}!" for k in range(80)), " ".join(f"w{k}" for k in range(55)), None, "", " ".join(f"w{k}" for k in range(70))]

    def rejected(text):
        n, chars, symbols, _, repeats = brute(text)
        if n < 50 or 100 * repeats > 50 * n:
            return True
        words = WORD.findall(text)
        real = [x for x in text.split("\n") if WORD.search(x)]
        share = lambda a, b: a / b if b else 0.0
        values = {
            "n_words": n, "word_length": share(chars, n), "symbol_share": share(symbols, chars), "dup_line_share": share(len(real) - len(set(real)), len(real)), "repeat_share": share(repeats, n),
            "upper_share": share(len(re.findall("[A-Z]", text)), chars), "bang_share": share(text.count("!"), chars), "distinct_share": share(len(set(words)), n),
        }
        return any(all((values[c.feature] > c.limit) == c.above for c in rule.conditions) for rule in rules)

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.kept for r in R.statistics(frame).select("id", R.verdict(rules).alias("kept")).collect()}
    assert got == {k: not rejected(t) for k, t in enumerate(texts)}
    assert {got[150], got[151], got[152], got[153]} == {False} and got[154]
