import random
from collections import Counter
from fractions import Fraction
from math import ceil, floor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import mixing as M


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", max_size=3), st.floats(0.001, 50), min_size=1, max_size=12))
def test_every_source_stays_within_one_block(weights):
    done, total = Counter(), sum(map(Fraction, weights.values()))
    for s, k, release, deadline, slot in M.exact_schedule(weights, dict.fromkeys(weights, 40)):
        assert k == done[s] and release <= slot < deadline
        done[s] += 1
        if max(done.values()) == 40:
            break
        for t in weights:
            assert abs(done[t] - (slot + 1) * Fraction(weights[t]) / total) < 1


@pytest.mark.parametrize("bucket", [200_000, 50])
def test_mix_of_a_table(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket)
    rows = [(k, f"s{k % 7 if k % 3 else 0}", k, "x") for k in range(1500)] + [(None, "s0", 1, "y"), (1, "s1", 1, "x"), (1, "s1", 1, "x"), (5000, None, 2, None), (5001, None, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot long, share string").repartition(4)
    weights = {"s0": 0.5, "s1": 0.2, "s2": 0.1, None: 0.01}
    got = M.mixed(docs, weights, block=4).collect()
    assert Counter((r.doc_id, r.source, r.share) for r in got) == Counter((a, b, d) for a, b, _, d in rows)
    given = {s: weights.get(s, 0.01) for s in {r[1] for r in rows}}
    sizes = Counter(r[1] for r in rows)
    at = {(s, k): tuple(x) for s, k, *x in M.exact_schedule(given, {s: -(-n // 4) for s, n in sizes.items()})}
    assert all(at[r.source, r.mix_block] == (r.mix_release, r.mix_deadline, r.mix_slot) for r in got)
    places = Counter((r.source, 4 * r.mix_block + r.mix_place) for r in got)
    assert set(places.values()) == {1}
    for s, n in Counter(r[1] for r in rows).items():
        assert {p for t, p in places if t == s} == set(range(n))


def test_empty_table(spark):
    assert M.mixed(spark.createDataFrame([], "doc_id long, source string")).collect() == []


def test_bad_weights_and_names(spark):
    with pytest.raises(ValueError):
        next(M.exact_schedule({"a": 0.0}, {"a": 1}))
    with pytest.raises(ValueError):
        M.mixed(spark.createDataFrame([(1, "a", 2)], "doc_id long, source string, _mix_n int"))


@pytest.mark.parametrize("seed", range(4))
def test_ranges_make_the_schedule_of_one_pass(spark, seed):
    """Weights far apart, sources that end early, long gaps, and ranges so short that guesses fail."""
    draw = random.Random(seed)
    weights = {f"s{k}": draw.choice([0.001, 0.37, 1.0, 3.3, 100.0]) * draw.random() for k in range(draw.choice([2, 9, 40]))} | {None: 0.5}
    blocks = {s: draw.choice([1, 2, 60, 400]) for s in weights}
    want = sorted(M.exact_schedule(weights, blocks), key=lambda r: r[4])
    for size in (7, 150):
        got = M.ranged_schedule(spark, weights, blocks, size).orderBy("mix_slot").collect()
        assert list(map(tuple, got)) == want
    pace = M.Pace(weights, blocks)
    assert len(pace.cuts(50)) >= 3 and pace.cuts(10**9) == [0]


def test_guesses_mostly_hold():
    weights = {f"s{k}": 1 / (k + 1) ** 0.5 for k in range(30)}
    pace = M.Pace(weights, dict.fromkeys(weights, 2000))
    cuts, held = pace.cuts(3000), 0
    done = [0] * 30
    for a, b, c in zip(cuts, cuts[1:], cuts[2:]):
        list(pace.run(done, a, b))
        guess = [d + g for d, g in zip(pace.due(a), pace.guess(a))]
        list(pace.run(guess, a, b))
        held += guess == done
    assert held >= len(cuts) - 4


@pytest.mark.parametrize("small", [50_000, 100])
def test_given_weights_hold_over_long_tables(spark, monkeypatch, small):
    monkeypatch.setattr(M, "SMALL_PLAN", small)
    monkeypatch.setattr(M, "RANGE", 1000)
    weights = {"s0": 0.5} | {f"s{k}": 0.5 / 9 for k in range(1, 10)}
    rows = [(k, "s0") for k in range(2700)] + [(3000 + k, f"s{1 + k % 9}") for k in range(2700)]
    got = M.mixed(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=1).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    total, done = sum(weights.values()), Counter()
    for at, r in enumerate(sorted(got, key=lambda r: r.mix_slot)):
        assert r.mix_slot == at and r.mix_release <= at < r.mix_deadline
        done[r.source] += 1
        for s, w in weights.items():
            assert abs(done[s] - (at + 1) * w / total) < 1 + 1e-9


def test_many_sources():
    weights = {f"s{k}": 1.0 + k % 3 for k in range(5000)} | {None: 0.25}
    out = list(M.exact_schedule(weights, dict.fromkeys(weights, 3)))
    assert Counter(s for s, *_ in out) == Counter(dict.fromkeys(weights, 3))
    assert all(release <= slot < deadline for _, _, release, deadline, slot in out)


def slots_by_plain_search(weights, blocks):
    """Slot by slot: of all released blocks that are left, the one with the earliest deadline, ties to the first source."""
    total = sum(Fraction(w) for w in weights.values())
    left = [(s, k, floor(k * total / Fraction(weights[s])), ceil((k + 1) * total / Fraction(weights[s]))) for s, n in blocks.items() for k in range(n)]
    names = sorted(blocks, key=lambda s: (s is None, s or ""))
    out, slot = {}, 0
    while left:
        ready = [x for x in left if x[2] <= slot]
        if ready:
            best = min(ready, key=lambda x: (x[3], names.index(x[0]), x[1]))
            left.remove(best)
            out[best[0], best[1]] = (best[2], best[3], slot)
        slot += 1
    return out


def test_schedule_and_order_match_brute_force(spark):
    rows = [(k, ("a", "b", "b", "c", None)[k % 5]) for k in range(230)] + [(500 + k, "a") for k in range(70)] + [(None, "c"), (7, "b"), (7, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    weights = {"a": 0.3, "b": 0.45, "c": 0.2, None: 0.05}
    got = M.mixed(docs, weights, block=3).collect()
    sizes = Counter(s for _, s in rows)
    want = slots_by_plain_search(weights, {s: -(-n // 3) for s, n in sizes.items()})
    assert all((r.mix_release, r.mix_deadline, r.mix_slot) == want[r.source, r.mix_block] for r in got)
    draws = dict(docs.select("doc_id", F.xxhash64(F.lit(3), "doc_id")).collect())
    for s in sizes:
        mine = sorted((r.mix_slot, r.mix_place, r.doc_id) for r in got if r.source == s)
        assert [draws[d] for *_, d in mine] == sorted(draws[d] for d, t in rows if t == s)
        assert [(n // 3, n % 3) for n in range(len(mine))] == sorted((r.mix_block, r.mix_place) for r in got if r.source == s)
