import random

import numpy as np
import pytest
import xxhash

from tidewire.llm import simhash as S
from tidewire.llm.bitslice import close_pairs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k=4, radius=4):
    def mark(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [(d, mark(t)) for d, t in rows]
    label = {d: d for d, _ in marks if d is not None}
    moved = True
    while moved:
        moved = False
        for d, f in marks:
            for e, g in marks:
                if None not in (d, e) and (f ^ g).bit_count() <= radius and label[d] != label[e]:
                    label[d] = label[e] = min(label[d], label[e])
                    moved = True
    return sorted(((d, f"{f:016x}", label.get(d)) for d, f in marks), key=str)


@pytest.mark.parametrize("words,radius", [(1, 4), (1, 0), (2, 32), (1, 64)])
def test_close_pairs_match_brute_force(words, radius):
    draw = np.random.default_rng(1)
    rows = draw.integers(0, 2**63, (300, words), dtype=np.uint64)
    for k in range(1, 300, 3):
        rows[k] = rows[k - 1] ^ np.uint64(draw.integers(0, 2) << int(draw.integers(0, 60)))
    first, last = np.repeat([0, 70, 299], [70, 229, 1]), np.repeat([70, 299, 300], [70, 229, 1])
    got = close_pairs(rows, first, last, radius, blocks=37)
    distance = np.bitwise_count(rows[:, None] ^ rows[None]).sum(2)
    want = {(i, j, int(distance[i, j])) for i in range(300) for j in range(i + 1, last[i]) if distance[i, j] <= radius}
    assert {*zip(got.i.tolist(), got.j.tolist(), got.distance.tolist())} == want


@pytest.mark.parametrize("tile", [2048, 4])
def test_classes_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    draw = random.Random(5)
    base = " ".join(f"w{draw.randrange(400)}" for _ in range(300)).split()
    rows = [(1, "One two three"), (2, "one TWO\tthree"), (3, None), (4, ""), (5, " \n "), (6, "É é"), (6, "É é"), (7, "x"), (8, "\xa0"), (None, "one two three")]
    for k in range(40):
        words = list(base)
        for _ in range(k % 4):
            words[draw.randrange(300)] = f"z{k}"
        rows.append((100 + k, " ".join(words)))
    rows.append((99, "long " * 50_000 + "end"))
    frame = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in S.simhash_classes(frame).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.simhash_classes(empty).collect() == []
    assert S.similar_classes(empty).collect() == []


def test_block_choices_lose_no_pair():
    draw = random.Random(3)
    for blocks in (5, 6, 7):
        masks = S.block_choices(blocks, 4)
        for _ in range(200):
            flips = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def test_similar_classes_follow_jaccard(spark):
    draw = random.Random(9)
    rows, want = [], {}
    for g in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        rows.append((10 * g, " ".join(words)))
        near, far = list(words), list(words)
        near[100] = "q"
        for k in range(0, 200, 12):
            far[k] = f"q{k}"
        rows += [(10 * g + 1, " ".join(near)), (10 * g + 2, " ".join(far)), (10 * g + 3, " ".join(words).upper())]
        want |= {10 * g: 10 * g, 10 * g + 1: 10 * g, 10 * g + 2: 10 * g + 2, 10 * g + 3: 10 * g}
    got = {r.doc_id: r.component_id for r in S.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def groups_by_jaccard(rows, k=5, similarity=0.8):
    """Classes by all pairs that are similar, and by those of them that are within the radius and meet in a table."""
    sets = [{*zip(*(t.split()[s:] for s in range(k)))} for _, t in rows]
    numbers = {}
    held = np.zeros((len(rows), sum(map(len, sets))), np.float32)
    marks = np.zeros((len(rows), 2), np.uint64)
    for n, grams in enumerate(sets):
        held[n, [numbers.setdefault(g, len(numbers)) for g in grams]] = 1
        hashes = np.array([xxhash.xxh64_intdigest(" ".join(g), 42) for g in grams], np.uint64)
        marks[n] = [S.majority(S.remixed(hashes, w)) for w in range(2)]
    held = held[:, : len(numbers)]
    shared, size = held @ held.T, held.sum(1)
    radius, masks = S.reach(13, similarity, 0.003)
    every, met = {d: d for d, _ in rows}, {d: d for d, _ in rows}
    for i, j in np.argwhere(np.triu(shared >= similarity * (size[:, None] + size - shared), 1)).tolist():
        x = marks[i] ^ marks[j]
        near = np.bitwise_count(x).sum() <= radius and not (x & np.array(masks, np.uint64)).any(axis=1).all()
        for label in (every, met) if near else (every,):
            a, b = sorted((label[rows[i][0]], label[rows[j][0]]))
            for d in [d for d, c in label.items() if c == b]:
                label[d] = a
    return every, met


@pytest.mark.parametrize("tile", [2048, 300])
def test_crowd_under_the_threshold_hides_no_similar_pair(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    draw = random.Random(11)

    def changed(words, n, mark):
        words = list(words)
        for k in draw.sample(range(2, 200), n):
            words[k] = f"{mark}x{k}"
        return words

    rows = []
    for g in range(1400):
        rows.append((g, changed([f"w{k}" for k in range(204)], 4, g)))
        if g % 14 == 0:
            rows.append((5000 + g, changed(rows[-1][1], 3, f"n{g}")))
    rows = [(d, " ".join(w)) for d, w in rows]
    every, want = groups_by_jaccard(rows)
    assert 60 < sum(d != c for d, c in want.items()) < 200
    assert sum(want[d] != every[d] for d in want) <= 2
    got = {r.doc_id: r.component_id for r in S.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_similar_classes_count_repeated_shingles_once(spark):
    draw = random.Random(17)
    rows, want = [], {}
    for g in range(30):
        words = " ".join(f"w{draw.randrange(10**6)}" for _ in range(100))
        line = " ".join(f"w{draw.randrange(10**6)}" for _ in range(10))
        rows += [(2 * g, "\n".join([words] + [line] * 10)), (2 * g + 1, f"{words}\n{line}")]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g}
    got = {r.doc_id: r.component_id for r in S.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
