import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidewire.llm import vector_codes as V
from tidewire.llm.queries import op13_vector_codes


def brute(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    """(id, code, error, label_error, digest) with Python's whole numbers, entry by entry."""
    kept = [(i, label, [math.floor(4096 * float(x)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wide = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    best = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = defaultdict(list)
            for _, _, v in kept:
                mine[best(cut(v, p), book)].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*mine[e])] if mine[e] else book[e] for e in range(len(book))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for i, label, v in kept:
        at = [best(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][e]) for p, e in enumerate(at))
        sums[label] += error
        out.append((i, "".join(f"{e:02x}" for e in at), error, label))
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def drawn(seed, n=120, dims=16, steps=4):
    """Few values, so that ties are common."""
    draw = random.Random(seed)
    return [(k * 3 % n, draw.choice([None, 1, 2]), [draw.randrange(-steps, steps) / 8 for _ in range(dims)]) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_codes_match_brute_force(spark, seed):
    rows = drawn(seed) + [(500, 1, None), (501, 1, [None] * 16), (502, 2, [math.nan] * 16), (503, 2, [math.inf] * 16), (None, None, [0.5] * 16), (7, 1, [0.25] * 16)]
    got = V.vector_codes(spark.createDataFrame([(i, v, label, "clash") for i, label, v in rows], SCHEMA))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_few_rows_hot_label_and_lengths(spark):
    few = [(k, 1, [k / 3] * 8) for k in range(3)]
    frame = lambda rows: spark.createDataFrame([(i, v, label, "") for i, label, v in rows], SCHEMA)
    assert sorted(map(tuple, V.vector_codes(frame(few)).collect()), key=str) == brute(few)
    # Another length and too large a component take no part.
    odd = few + [(9, 1, [1.0] * 7), (10, 1, [1e30] * 8), (11, 1, [])]
    assert sorted(map(tuple, V.vector_codes(frame(odd)).collect()), key=str) == brute(few)
    large = few + [(12, 2, [120_000.0] * 8), (13, 2, [-120_000.5] * 7 + [0.25]), (14, None, [119_999.75] * 8)]
    assert sorted(map(tuple, V.vector_codes(frame(large)).collect()), key=str) == brute(large)
    # Ten components are filled up to sixteen.
    ten = [(k, 1, [k / 3] * 10) for k in range(30)]
    assert sorted(map(tuple, V.vector_codes(frame(ten)).collect()), key=str)[0][1:4] == brute([(i, label, v + [0.0] * 6) for i, label, v in ten])[0][1:4]
    assert [r.code for r in V.vector_codes(frame([(1, None, []), (2, None, [])])).collect()] == ["00" * 8] * 2
    assert V.vector_codes(frame(few).limit(0)).collect() == []


@pytest.mark.parametrize("size", [8, 1000, 1 << 23, 1 << 26])
def test_intervals_hold_the_nearest_entry(size):
    """Entries that float32 can't tell apart, at sizes where its products round."""
    rng = np.random.default_rng(size)
    for terms in (1, 3, 8, 64):
        base = rng.integers(-size, size + 1, (1, terms))
        book = base + rng.integers(-1, 2, (16, terms))
        x = np.concatenate([base + rng.integers(-2, 3, (300, terms)), rng.integers(-size, size + 1, (300, terms)), book])
        best, far, again = V.nearest(x, book)
        exact = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
        assert again > 0


def test_screening_settles_most_rows():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-2500, 2500, (20_000, 8)), rng.integers(-2500, 2500, (16, 8))
    assert V.nearest(x, book)[2] < 20


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_matches_sql_and_brute_force(spark, sf):
    table = f"/root/testdata/{sf}/embeddings.parquet"
    got = sorted(map(tuple, op13_vector_codes(spark, f"/root/testdata/{sf}").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{table}'")
    assert got == sorted(con.execute(V.codes_sql()).fetchall(), key=str)
    assert got == brute(con.execute("select vec_id, label, embedding from embeddings").fetchall())
