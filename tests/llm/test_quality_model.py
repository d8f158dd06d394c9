import math
import zlib

import zstandard

from tidewire.llm import quality_model as Q

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = Q.scored(docs, Q.learn(docs, labels)).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    both = out[out["held_out"]].merge(labels.toPandas(), on="doc_id").dropna(subset=["quality"])
    rank = both["score"].rank()
    good = both["quality"] == 1
    auc = (rank[good].mean() - rank[~good].mean()) / len(both) + 0.5
    right = both["predicted"] == both["quality"]
    assert auc > 0.98 and right.mean() > 0.95, (auc, right.mean())
    assert right[good].mean() > 0.97


def test_only_texts_and_learnable_labels_count(spark):
    rows = [(k, f"good calm words {k} " * 20 if k % 2 else f"!!! ### {k} $$$ " * 20, "x", 0.5) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    told = [(k, k % 2) for k in range(80) if zlib.crc32(str(k).encode()) % 4 != 2]
    lies = [(k, 1 - k % 2) for k in range(80) if zlib.crc32(str(k).encode()) % 4 == 2]
    first = Q.learn(docs, spark.createDataFrame(told, "doc_id long, quality int"))
    again = Q.learn(docs, spark.createDataFrame(told + lies + [(None, 1), (5000, None)], "doc_id long, quality int"))
    assert first == again
    out = {r.doc_id: r.predicted for r in Q.scored(docs, first).collect()}
    assert sum(out[k] == k % 2 for k in out) >= 78


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (2, ""), (3, "long " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.scored(docs, Q.learn(docs, none)).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5} and {r.predicted for r in out} == {0}
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in Q.scored(docs, Q.learn(docs, one)).collect())
    assert Q.scored(docs.limit(0), Q.learn(docs.limit(0), none)).collect() == []


def test_scores_match_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = Q.learn(docs, labels, rows=400, bytes_=1 << 20)
    texts = dict(docs.orderBy("doc_id").limit(60).select("doc_id", "text").collect()) | {10**9: None, 10**9 + 1: "", 10**9 + 2: "é" * 5000, 10**9 + 3: "one " * 60_000}

    def saved(text):
        raw, sizes = (text or "").encode(), []
        for dictionary in (model.good, model.bad):
            # A packer of its own for each piece: nothing is carried from one to the next.
            pack = lambda piece: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False).compress(piece)  # noqa: B023, E731
            sizes.append(sum(len(pack(raw[k : k + 256])) for k in range(0, len(raw), 256)))
        return (sizes[1] - sizes[0]) / max(1, len(raw))

    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in Q.scored(frame, model).collect():
        want = 1 / (1 + math.exp(-(model.slope * saved(texts[r.doc_id]) + model.offset)))
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_one_long_text_does_not_displace_the_sample(spark):
    rows = [(k, (f"calm words here {k} " if k % 2 else f"$$$ !!! {k} ###") * 30) for k in range(200)] + [(500, "calm " * 200_000), (501, "### " * 200_000)]
    labels = spark.createDataFrame([(k, k % 2 if k < 500 else 1 - k % 2) for k, _ in rows], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.learn(docs, labels, bytes_=400_000)
    assert model.good and model.bad and model.slope > 0
    assert model == Q.learn(docs.where("doc_id < 500"), labels, bytes_=400_000)
