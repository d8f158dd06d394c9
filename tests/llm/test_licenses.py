import itertools
import random
import re

import pytest

from tidewire.llm import licenses as L

TAG = "SPDX-License-Identifier: "


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def base_of(words):
    starts, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def phrase_labels(words):
    """At each word the longest phrase, by trying all."""
    out = set()
    for k in range(len(words)):
        fits = [p for p in L.PHRASES if words[k : k + len(p.split())] == p.split()]
        if fits:
            out.add(L.PHRASES[max(fits, key=len)][0])
    return out


DRAW = random.Random(11)
PIECES = ["mit", "License", "MIT\nLicense", "apache license", "version", "2.0", "general", "public", "license,", "x", "é", " ", "mit license", "cc by-nc 4.0", "cc by", "gnu", "lesser", "_", "-", "ÀMIT license"]
TEXTS = [
    None, "", " ", "mit", "MIT LICENSE", "mit_license", "mit  -license", "mitlicense", "mit licenses", "mit license mit license", "Apache license. GENERAL\n public--license", "İ mit license", "licensed under cc by-nc 4.0.",
    "x " * 3_000 + "mit license", "general public license version 3 general public license", "mit license", "mit\x00license", TAG + "MIT", TAG.lower() + "Nobody-1.0", '"license": "Nobody"', '"license": "ISC"', TAG,
] + [" ".join(DRAW.choice(PIECES) for _ in range(DRAW.randrange(12))) for _ in range(300)]


def test_scan_matches_brute_force(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "mit license", None), (5, "again: bsd license", "x")]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    of = {(r.doc_id, r.n_words): r for r in got}
    for doc_id, text, _ in rows:
        words = words_of(text)
        row = of[doc_id, len(words)]
        assert tuple(row[1:6]) == base_of(words), text
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(row.labels)
        if "icense-" not in (text or "") and '"' not in (text or ""):
            assert set(filter(None, row.labels.split(","))) == phrase_labels(words) | set(filter(None, row.base_labels.split(","))), text
    by_text = {t: of[k, len(words_of(t))] for k, t in enumerate(TEXTS)}
    assert by_text[TAG + "MIT"].labels == "mit" and by_text[TAG.lower() + "Nobody-1.0"].labels == "nobody-1.0"
    assert by_text['"license": "Nobody"'].labels == "" and by_text['"license": "ISC"'].labels == "isc" and by_text[TAG].labels == ""


IDS = {"mit": 0.9, "gpl-3.0-only": 0.4, "cc-by-nc-4.0": 0.1, "nobody": L.UNKNOWN}


def descent(tokens):
    """(value, labels) by recursive descent: another way than two stacks."""
    labels = []

    def either():
        value = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            value = max(value, both())
        return value

    def both():
        value = one()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            value = min(value, one())
        return value

    def one():
        token = tokens.pop(0)
        if token == "(":
            value = either()
            tokens.pop(0)
            return value
        if tokens and tokens[0] == "with":
            tokens.pop(0)
            labels.append(f"{token} with {tokens.pop(0)}")
            return min(1.0, IDS[token] + L.EXCEPTION)
        labels.append(token)
        return IDS[token]

    return either(), labels


def drawn(draw, depth):
    if depth == 0 or draw.random() < 0.3:
        return draw.choice(list(IDS)) + (" with note" if draw.random() < 0.3 else "")
    inner = f" {draw.choice(['or', 'AND', 'and', 'Or'])} ".join(drawn(draw, depth - 1) for _ in range(draw.randrange(1, 4)))
    return f"({inner})" if draw.random() < 0.7 else inner


@pytest.mark.parametrize("seed", range(40))
def test_expressions_match_recursive_descent(seed):
    draw = random.Random(seed)
    for _ in range(10):
        text = drawn(draw, 4).lower()
        got = L.parsed(text.encode())
        tokens = re.findall(r"[()]|[^\s()]+", text)
        assert got.tokens == tokens
        value, labels = descent(list(tokens))
        assert got.value == pytest.approx(value) and sorted(got.labels) == sorted(labels)


def test_the_longest_whole_expression_counts():
    cases = {"mit": "mit", "mit or": "mit", "mit or (isc": "mit", "(mit) isc": "( mit )", "mit */": "mit", "mit.": "mit", "mit)": "mit", "": None, "or": None, "(": None, "()": None, "mit with": "mit", "(mit) with x": "( mit )",
             "mit with a with b": "mit with a", "mit\nor isc": "mit", "gpl-2.0+ and isc": "gpl-2.0+ and isc"}
    for text, tokens in cases.items():
        got = L.parsed(text.encode())
        assert (got and " ".join(got.tokens)) == tokens, text
    deep = L.parsed(b"(" * 200_000 + b"mit" + b")" * 200_000)
    assert deep.labels == ["mit"] and deep.value == 0.9


def test_freedom_by_family():
    known = {"gpl-3.0-or-later": 0.4, "lgpl-2.1": 0.6, "bsd-3-clause": 0.9, "cc-by-nc-sa-4.0": 0.1, "apache-2.0": 0.9, "0bsd": 1.0, "gpl-2.0+": 0.4, "nobody-1": None, "-": None}
    assert {k: L.freedom(k) for k in known} == known
    assert all(p == " ".join(words_of(p)) for p in itertools.chain(L.BASE, L.PHRASES))


def test_empty_table(spark):
    got = L.license_scan(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", *(c.split()[0] for c in L.COLUMNS.split(", "))] and got.collect() == []
