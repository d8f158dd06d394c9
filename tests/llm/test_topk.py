import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import topk as K


def brute(rows, k, every):
    usable = []
    for d, v in rows:
        if d is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((d, [math.floor(256 * x) for x in v]))
    out = []
    seen = set()
    for d, v in usable:
        if d % every or (d, tuple(v)) in seen:
            continue
        seen.add((d, tuple(v)))
        scores = sorted((-sum(a * b for a, b in zip(v, w)), e) for e, w in usable if e != d and len(w) == len(v))
        out += [(d, r + 1, e, -s) for r, (s, e) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("tiles,cells,batch", [(12, 1 << 21, 10_000), (3, 64, 7)])
def test_matches_brute_force(spark, monkeypatch, tiles, cells, batch):
    monkeypatch.setattr(K, "LEAST_TILES", tiles)
    monkeypatch.setattr(K, "CELLS", cells)
    draw = random.Random(4)
    rows = [(d, [float(np.float32(draw.gauss(0, 0.3))) for _ in range(20)]) for d in range(400)]
    rows += [(d, rows[3][1]) for d in range(400, 420)] + [(50, rows[50][1])]
    rows += [(1000, None), (1001, []), (1002, [None] + [0.1] * 19), (1003, [float("nan")] * 20), (1004, [float("inf")] * 20), (None, rows[0][1]), (1050, [0.5, 0.25]), (1051, [0.5, -1.0]), (1052, [0.0, 0.0])]
    frame = spark.createDataFrame([(d, v, 9) for d, v in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = K.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == brute(rows, 5, 50)


def test_bounds_hold_at_every_level():
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=(50, 37)), draw.normal(size=(60, 37))
    exact, last = a @ b.T, None
    for s in (1, 4, 16, 37):
        cuts = K.equal_energy(np.ones(37), s)
        assert len(cuts) == s and cuts[-1] == 37
        upper = K.segment_statistics(a, cuts) @ K.segment_statistics(b, cuts).T
        assert (upper >= exact - 1e-9).all()
        assert last is None or upper.mean() < last
        last = upper.mean()


def _tile(vectors):
    tile = K.Tile(np.arange(len(vectors)), vectors)
    got = tile.search(np.arange(0, len(vectors), 50), vectors[::50], 5)
    score = (vectors[::50] @ vectors.T).astype(float)
    score[np.arange(len(score)), np.arange(0, len(vectors), 50)] = -np.inf
    want = [(q, x, score[q, x]) for q in range(len(score)) for x in np.lexsort((np.arange(len(vectors)), -score[q]))[:5]]
    assert [*zip(*(x.tolist() for x in got))] == [(q, x, int(s)) for q, x, s in want]
    return tile


def test_pairs_are_dropped_before_their_exact_score_where_vectors_lie_near_a_subspace():
    draw = np.random.default_rng(2)
    spread = draw.normal(size=(4000, 64)) * np.where(np.arange(64) < 6, 100, 2)
    turn = np.linalg.qr(draw.normal(size=(64, 64)))[0]
    tile = _tile(np.floor(spread @ turn).astype(np.int64))
    assert tile.shares[-1] < 0.1 and tile.used
    # Without such a subspace bounds can't drop much, and the levels that don't pay are left out.
    even = _tile(np.floor(draw.normal(size=(4000, 64)) * 100).astype(np.int64))
    assert even.shares[-1] > 0.5 and not even.used


def test_few_rows_and_empty_table(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in K.top_k(one, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert K.top_k(one.limit(0), F.col("vec_id") % 50 == 0).collect() == []
