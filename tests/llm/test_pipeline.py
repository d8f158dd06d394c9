"""Each stage of the pipeline against a plain version, on a table with every odd case."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, first boolean, kept boolean, text_key long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def fresh(draw, n):
    return [f"w{draw.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(23)
    base, passage = fresh(draw, 120), fresh(draw, 60)
    out = [(k, " ".join(fresh(draw, 80)), "en", f"s{k % 4 if k % 3 else 0}") for k in range(40)]
    for k in range(100, 112):
        words = list(base)
        words[draw.randrange(120)] = f"edit{k}"
        out.append((k, " ".join(words), "en", "s1"))
    out += [(200, " ".join(base).upper(), "en", "s2"), (201, "\n".join(base), None, None), (202, " ".join(base), "en", "s3"), (202, " ".join(base), "fr", "s3")]
    out += [(k, " ".join(fresh(draw, 30) + passage + fresh(draw, 20)), "en", "s0") for k in range(300, 306)]
    out += [(310, " ".join(passage), "en", "s0"), (311, "short text", "en", "s0"), (312, "same word again " * 50, "en", "s0"), (313, None, None, None), (314, "", "en", "s0")]
    out += [(None, "too short", "en", "s0"), (None, " ".join(fresh(draw, 70)), "en", None), (None, " ".join(base), "en", "s0")]
    # One id with a text to reject, a text to keep, and a copy of another's.
    out += [(400, "junk", "en", "s0"), (400, " ".join(fresh(draw, 90)), "en", "s0"), (400, " ".join(base), "en", "s0"), (401, " ".join(fresh(draw, 30_000)), "en", "s1")]
    return [(d, t, g, s, len(t or "")) for d, t, g, s in out]


@pytest.fixture(scope="module")
def labels(tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, False, 7) for r in rows], SCHEMA).repartition(3)


def plain(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def passes(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    again = {k for i, g in enumerate(grams) if seen[g] > 1 for k in (i, i + 1, i + 2)}
    return len(words) >= 50 and 100 * len(again) <= 50 * len(words)


def test_quality_rules(spark, rows, labels):
    got = plain(corpus_pipeline.quality_rules(spark, frame(spark, rows), labels))
    assert got == sorted((r for r in rows if passes(r[1])), key=repr)


def test_near_duplicates(spark, rows, labels):
    rows = [r for r in rows if passes(r[1])]

    def grams(text):
        words = [w.lower() for w in WORD.findall(text)]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    known = sorted((r for r in rows if r[0] is not None), key=repr)
    sets, label = [grams(r[1]) for r in known], list(range(len(known)))
    for i in range(len(known)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    got = plain(corpus_pipeline.near_duplicates(spark, frame(spark, rows), labels))
    assert [r for r in got if r[0] is None] == sorted((r for r in rows if r[0] is None), key=repr)
    kept = [r for r in got if r[0] is not None]
    assert len(kept) == len(set(label)) and set(kept) <= set(known)
    for c in set(label):
        mine = [r for r, x in zip(known, label) if x == c]
        left = [r for r in kept if r in mine]
        assert len(left) == 1 and left[0][0] == min(r[0] for r in mine)


def test_substring_dedup(spark, rows, labels):
    split = [(r, WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for r, words in split:
        for s in range(len(words) - 49 if r[0] is not None else 0):
            key = tuple(words[s : s + 50])
            first[key] = min(r[0], first.get(key, r[0]))
    want = []
    for r, words in split:
        gone = {k for s in range(len(words) - 49 if r[0] is not None else 0) if first[tuple(words[s : s + 50])] < r[0] for k in range(s, s + 50)}
        if not gone:
            want.append((r[0], WORD.findall(r[1] or ""), r[2:5]))
        elif len(gone) < len(words):
            want.append((r[0], [w for k, w in enumerate(words) if k not in gone], (*r[2:4], None)))
    got = corpus_pipeline.substring_dedup(spark, frame(spark, rows), labels)
    assert got.columns == corpus_pipeline.COLUMNS
    out = [(r.doc_id, WORD.findall(r.text or ""), (r.lang, r.source, r.n_chars)) for r in got.collect()]
    assert all(r.n_chars == len(r.text or "") for r in got.collect())
    strip = lambda x: sorted((repr((d, w, m[:2])) for d, w, m in x))
    assert strip(out) == strip(want)


def test_mixing(spark, rows, labels, tmp_path):
    out = corpus_pipeline.mixing(spark, frame(spark, rows), labels)
    assert plain(out) == sorted(rows, key=repr)
    path = str(tmp_path / "mixed")
    out.write.parquet(path)
    from pyspark.sql import functions as F

    order = spark.read.parquet(path).select("source", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")).orderBy("file", "at").collect()
    sizes = {s: sum(r[3] == s for r in rows) for s in {r[3] for r in rows}}
    # Blocks of 64 documents: here every source but the largest is one block, and no source comes in two runs before another has begun.
    runs = [s for k, s in enumerate(x.source for x in order) if k == 0 or order[k - 1].source != s]
    assert len(runs) == sum(-(-n // 64) for n in sizes.values())


def test_pieces(spark, rows, labels, tmp_path):
    path = str(tmp_path / "docs")
    frame(spark, rows).select(corpus_pipeline.COLUMNS).write.parquet(path)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    want = []
    for d, text, *_ in rows:
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    for docs in (spark.read.parquet(path), frame(spark, rows)):
        got = corpus_pipeline.pieces(spark, docs, labels)
        assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()), key=repr) == sorted(want, key=repr)
        assert {"spans_sha256", "mix_part", "mix_row"} <= set(got.columns)


def test_empty_tables(spark, labels, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), labels).collect() == []


def test_run_goes_through_all_stages(spark, rows, labels):
    frame(spark, rows).select(corpus_pipeline.COLUMNS).write.mode("overwrite").parquet(f"{labels}/documents.parquet")
    got = corpus_pipeline.run(spark, labels)
    ids = [r.doc_id for r in got.collect()]
    assert 401 in ids and 0 in ids and 311 not in ids and 200 not in ids
    assert len({(r.mix_part, r.mix_row) for r in got.collect()}) == len(ids)
