import random
import re

import pytest

from tidewire.llm import url_filter as U


def as_regex(glob):
    return re.compile("".join({"*": "[^/]*", "**": ".*"}.get(t, re.escape(t)) for t in U.parsed(glob)), re.S)


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        head = re.split(r"[?#]", url[url.index("://") + 3 :], maxsplit=1)[0]
        host, slash, rest = head.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + rest
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    other = "block" if any(as_regex(b).fullmatch(host + path) for b in U.BLOCKED) else "allow"
    return host, path, best and best.name, best.verdict if best else other


URLS = [
    None, "", "nothing", "://", "http://", "http://org/", "http://org", "http://ORG/x", "https://a.Example.ORG/es/x?q#f", "http://example.org/en/1", "http://example.org/en/12/3",
    "http://notexample.org/es/", "http://example.org?x=/es/", "http://example.org#/es/", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/de", "http://com/de/",
    "http://a.net/x.org/y", "http://a.net/b://c.org/", "http://u:p@h.com:80/fr/", "http://casino-win.example.net/", "http://x.net/casino/", "http://a.net/a/login.php",
    "http://a.net/a/f.exe", "http://a.net/cart/x", "http://é.net/ü/login", "http://ÀB.org/", "x" * 3000 + "://h.org/" + "y" * 5000, "http://.org/", "http://a.net/\n.exe",
]


def test_automaton_matches_regexes():
    draw = random.Random(2)
    globs = ["".join(draw.choice(["a", "b", "/", "*", "**"]) for _ in range(draw.randrange(1, 9))) for _ in range(120)] + ["a" * 150 + "*b", "", "*", "**"]
    texts = ["".join(draw.choice("ab/") for _ in range(draw.randrange(9))) for _ in range(200)] + ["a" * 150 + "xxb", "a" * 151]
    got = U.Automaton([U.parsed(g) for g in globs]).fits([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(as_regex(g).fullmatch(t)), (t, g)


@pytest.mark.parametrize("words", [1 << 20, 8])
def test_verdicts_match_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(U, "STATE_WORDS", words)
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(None, URLS[8], None), (5, URLS[5], "again")]
    got = U.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *brute(u)) for d, u, _ in rows), key=str)


def test_no_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://org/")], "page_id long, url string")
    assert [tuple(r) for r in U.url_verdicts(pages, (), ()).collect()] == [(1, "org", "/", None, "allow")]
    assert U.url_verdicts(pages.limit(0)).collect() == []
