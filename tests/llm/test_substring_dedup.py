import random

import pytest

from tidewire.llm import substring_dedup as D

SCHEMA = "doc_id long, text string, starts string"


def brute(rows, length):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in docs:
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in docs:
        gone = set()
        for s in range(len(w) - length + 1):
            if d is not None and first[tuple(w[s : s + length])] < d:
                gone |= set(range(s, s + length))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_covers_hold():
    for period, members in D.COVERS.items():
        assert {(a - b) % period for a in members for b in members} == set(range(period))
    assert D.period_for(50) == 31


@pytest.mark.parametrize("length,batch", [(50, 16 << 20), (50, 400), (12, 3000), (9, 16 << 20), (3, 5000)])
def test_matches_brute_force(spark, monkeypatch, length, batch):
    monkeypatch.setattr(D, "BATCH_BYTES", batch)
    draw = random.Random(length)
    fresh = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    shared = [fresh(length + k) for k in (0, 1, 5, 30)]
    base = fresh(150)
    rows = [(0, " ".join(base)), (None, " ".join(base)), (5, None), (6, ""), (7, " \n\t "), (9, "a " * 400), (8, "a " * 200), (3, "x\xa0y z"), (4, " ".join(base)), (4, " ".join(base))]
    for d in range(20, 70):
        words = fresh(draw.randrange(5, 60))
        for _ in range(draw.randrange(3)):
            words += draw.choice(shared) + fresh(draw.randrange(20))
        rows.append((d, draw.choice([" ", "\n", "  "]).join(words)))
    for d in range(100, 110):
        words = list(base)
        words[draw.randrange(150)] = "edit"
        rows.append((d, " ".join(words)))
    rows.append((200, " ".join(fresh(20_000) + shared[3])))
    draw.shuffle(rows)
    frame = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)
    got = D.without_repeats(frame, length=length).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in got), key=str) == brute(rows, length)
    texts = {r.doc_id: r.text for r in got}
    for r in got:
        assert (r.text or "").encode().split() == r.kept_words.encode().split()
    assert texts[5] is None and texts[7] == " \n\t "


def test_texts_under_one_id_lose_only_their_own_repeats(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, f"{c} {b}"), (3, c), (3, c), (4, f"x {a} y"), (4, f"{b} z")]
    got = D.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = [(1, a), (2, ""), (2, b), (3, c), (3, c), (3, c), (4, "x y"), (4, "z")]
    assert sorted((r.doc_id, r.kept_words) for r in got) == sorted(left)


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        D.without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty_table(spark):
    assert D.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_texts_under_one_id(spark):
    draw = random.Random(4)
    runs = [" ".join(f"r{k}_{j}" for j in range(60)) for k in range(12)]
    texts = [f"{draw.choice(runs)} own{k} {draw.choice(runs)}" for k in range(60)]
    rows = [(0, runs[0]), (1, texts[0]), (1, "short"), (1, None)] + [(7, t) for t in texts] + [(7, "short"), (7, runs[0]), (8, texts[1]), (8, texts[0])]
    got = D.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in got), key=str) == brute(rows, 50)


@pytest.mark.parametrize("small", [True, False])
def test_texts_are_shuffled_once(spark, monkeypatch, tmp_path, small):
    if not small:
        monkeypatch.setattr(D, "counted", lambda df: (D.written(df), 1 << 30))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = [(d, " ".join(f"w{d % 3 if k < 70 else d}_{k}" for k in range(80))) for d in range(30)] + [(1, " ".join(f"w2_{k}" for k in range(70)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    out = D.without_repeats(spark.read.parquet(f"{tmp_path}/docs"))
    try:
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(brute(rows, 50))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    shuffled = [k for k, line in enumerate(plan) if "- Exchange hashpartitioning" in line and "text#" in plan[k + 1] and "MapInArrow" not in plan[k + 1]]
    assert len(shuffled) == 1, plan
    assert sum("ReusedExchange" in line and "text#" in line for line in plan) == 2
