import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidewire.llm import spelling as S
from tidewire.llm.queries import op12_spelling_variants


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return n


def brute(rows, length=6, count=5):
    """Every word against its own deletions, insertions and replacements: no keys, no halves."""
    n = {w: c for w, c in counted(rows).items() if len(w) >= length and c >= count}
    letters = sorted({x for w in n for x in w})
    out, forms = {}, {}
    for w in n:
        near = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + x + w[k:] for k in range(len(w) + 1) for x in letters} | {w[:k] + x + w[k + 1 :] for k in range(len(w)) for x in letters}
        near = [x for x in near - {w} if x in n]
        form = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = form if form is not None and n[form] >= 5 * n[w] else None
        out[w] = len(near)
    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w
    return sorted(((w, forms[w], root(w), n[w], out[w], n[forms[w]] if forms[w] else None) for w in n), key=str)


SCHEMA = "doc_id long, text string, word string"


def as_rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_variants_match_brute_force(spark, seed):
    """Words over few letters: many anagrams, doubled letters and chains."""
    draw = random.Random(seed)
    words, weights = [], []
    for _ in range(15):
        word = "".join(draw.choice("abé") for _ in range(draw.randrange(7, 10)))
        for weight in (216, 36, 6, 6, 1):
            words.append(word)
            weights.append(weight)
            k = draw.randrange(len(word))
            word = draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice("abé") + word[k:], word[:k] + draw.choice("abé") + word[k + 1 :]])
    rows = [(k, draw.choice([" ", "-", "9", "\n"]).join(draw.choices(words, weights, k=draw.randrange(160)))) for k in range(300)]
    rows += [(1, None), (2, ""), (None, "aaaaaa " * 6), (3, rows[3][1]), (4, "ABAÉÀ×÷ÿabab " * 7), (5, "a" * 30_000 + " " + "a" * 29_999), (6, ("b" * 500 + " ") * 5 + ("b" * 499 + " ") * 30)]
    got = as_rows(S.spelling_variants(spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)))
    want = brute(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)


def test_every_single_edit_meets(spark):
    """Each edit of a word at each place, first, last and middle ones included."""
    for word in ("abcdef", "aabbaab"):
        edits = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + x + word[k:] for k in range(len(word) + 1) for x in "axÿ"} | {word[:k] + x + word[k + 1 :] for k in range(len(word)) for x in "axÿ"}
        words = spark.createDataFrame([(w, 1) for w in edits | {word, word[::-1] + "q"}], "word string, n long")
        got = S.near_pairs(words).where(f"word = '{word}'").collect()
        assert sorted(r.other for r in got) == sorted(edits - {word})


def test_keys_of_exchanges_are_distinct(spark):
    """No two exchanges of one letter for another change a key alike."""
    letters = [ord(x) ** 5 for x in S.LOWER] + [x**5 for x in range(0xC0, 0x100)]
    seen = defaultdict(set)
    for a in letters:
        for b in letters:
            if a != b:
                seen[a - b].add((a, b))
    assert all(len(x) == 1 for x in seen.values())
    got = spark.createDataFrame([("abé", "éba")], "a string, b string").select(S.anagram_key("a"), S.anagram_key("b")).first()
    assert got[0] == got[1] == 97**5 + 98**5 + 233**5


def test_query_on_a_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(op12_spelling_variants(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_empty_table(spark):
    assert as_rows(S.spelling_variants(spark.createDataFrame([], SCHEMA))) == []
