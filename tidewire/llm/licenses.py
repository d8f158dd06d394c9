"""License scans: one Aho-Corasick pass over words, one over marks of tags, and a shunting-yard parser for expressions.

Notice phrases stand in a text's words, so line breaks, commas and hyphens
between them don't matter: a text becomes its words with one blank around each,
and one automaton finds all phrases at once. Identifier tags introduce an
expression in the raw text (`mit or (gpl-2.0-only with x and bsd)`): an
automaton finds the tags, and operator precedence parsing over two stacks reads
and evaluates the longest whole expression after each, whatever its nesting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import byte_slices

#: The phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence families by the stem of their identifiers: how freely a text under them may be used, from 0 to 1.
FREEDOM = {
    "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "wtfpl": 1.0, "pddl": 1.0,
    "mit": 0.9, "bsd": 0.9, "isc": 0.9, "zlib": 0.9, "apache": 0.9, "bsl": 0.9, "psf": 0.9, "python": 0.9, "ncsa": 0.9, "cc-by": 0.9,
    "mpl": 0.6, "lgpl": 0.6, "epl": 0.6, "cddl": 0.6, "eupl": 0.5, "artistic": 0.6, "cc-by-sa": 0.5,
    "gpl": 0.4, "agpl": 0.3, "sspl": 0.2,
    "cc-by-nd": 0.2, "cc-by-nc": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.1, "proprietary": 0.0,
}
#: What an identifier of no known family counts for, and what an exception adds.
UNKNOWN, EXCEPTION = 0.2, 0.2

#: How sure a kind of evidence makes of its label.
TAG, NOTICE, NAME = 0.95, 0.8, 0.5


def _phrases() -> dict[str, tuple[str, float]]:
    """Phrases of words with the label and the weight of each; of phrases that begin at one word the longest counts."""
    named = {
        "mit": ["mit license", "mit licence", "expat license"],
        "apache": ["apache license", "apache licence", "apache software license"],
        "gpl": ["general public license", "general public licence", "gnu gpl"],
        "lgpl": ["lesser general public license", "library general public license", "gnu lgpl"],
        "agpl": ["affero general public license", "gnu agpl"],
        "mpl": ["mozilla public license"],
        "epl": ["eclipse public license"],
        "eupl": ["european union public licence"],
        "cddl": ["common development and distribution license"],
        "bsd": ["bsd license", "bsd licence", "2 clause bsd", "3 clause bsd", "bsd 2 clause", "bsd 3 clause"],
        "isc": ["isc license"],
        "zlib": ["zlib license"],
        "bsl": ["boost software license"],
        "artistic": ["artistic license"],
        "unlicense": ["the unlicense"],
        "cc0": ["cc0", "creative commons zero"],
    }
    versions = {"apache": ("2 0", "1 1"), "gpl": ("2", "3", "2 0", "3 0"), "lgpl": ("2 1", "3", "3 0"), "agpl": ("3", "3 0"), "mpl": ("1 1", "2 0"), "epl": ("1 0", "2 0"), "cc0": ("1 0",)}
    out: dict[str, tuple[str, float]] = {}
    for label, names in named.items():
        for name in names:
            out[name] = (label, NAME)
            for version in versions.get(label, ()):
                dotted = version.replace(" ", ".") if " " in version else f"{version}.0"
                for link in (" ", " v", " version ", " version v"):
                    out[name + link + version] = (f"{label}-{dotted}", NOTICE)
    terms = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
    for parts in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label = "cc-" + "-".join(parts)
        for name in ("cc " + " ".join(parts), "creative commons " + " ".join(terms[p] for p in parts), "creativecommons org licenses " + " ".join(parts)):
            out[name] = (label, NAME)
            for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
                out[f"{name} {version}"] = out[f"{name} international {version}"] = (f"{label}-{version.replace(' ', '.')}", NOTICE)
    out |= {
        "permission is hereby granted free of charge to any person obtaining a copy": ("mit", NOTICE),
        "redistribution and use in source and binary forms with or without modification": ("bsd", NOTICE),
        "permission to use copy modify and or distribute this software for any purpose": ("isc", NOTICE),
        "this is free and unencumbered software released into the public domain": ("unlicense", NOTICE),
        "this program is free software you can redistribute it and or modify": ("gpl", NOTICE),
        "all rights reserved": ("proprietary", 0.3),
    }
    return out


PHRASES = _phrases()
#: Marks of a tag; after the last two an expression counts only if all its identifiers are of known families.
TAGS = {"spdx-license-identifier:": True, "license-expression:": False, '"license":': False}

#: Bytes of a text to those of its words: A-Z to a-z, other ASCII but digits and letters to blanks.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([a-z0-9][a-z0-9.:-]*\+?))")
_RANK = {"or": 1, "and": 2, "with": 3}
_LICENCE = re.compile(r"^(.+?)(?:-v?\d.*|-(?:clause|only|or-later).*|\+)?$")


def freedom(identifier: str) -> float | None:
    """Of an identifier (lower case) by the longest stem of a known family; None if it is of none."""
    stem = _LICENCE.match(identifier)[1]
    while stem:
        if stem in FREEDOM:
            return FREEDOM[stem]
        stem = stem.rpartition("-")[0]
    return None


@dataclass
class Expression:
    """The longest whole expression at a place: its tokens, its labels and what it allows (or: the freer side, and: the stricter one)."""

    tokens: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    value: float = 0.0
    known: bool = True


def parsed(raw: bytes, at: int = 0) -> Expression | None:
    """The expression that begins at `at`; None if there is none.

    `with` binds more than `and`, `and` more than `or`; all go left to right.
    A token that can't go on ends the expression; what an unclosed bracket or
    an operator without a right side leaves over is given up.
    """
    tokens, ends, depth, operand = [], 0, 0, False
    quote = re.compile(rb'[ \t]*["\']?').match(raw, at)
    at = quote.end()
    while (m := _TOKEN.match(raw, at)) is not None:
        at, bracket, word = m.end(), m[1], m[2] and m[2].decode().rstrip(".:-")
        if bracket == b"(":
            if operand:
                break
            depth += 1
        elif bracket == b")":
            if not operand or not depth:
                break
            depth -= 1
        elif word in _RANK:
            if not operand or word == "with" and (tokens[-1] == ")" or len(tokens) > 1 and tokens[-2] == "with"):
                break
            operand = False
        else:
            if operand:
                break
            operand = True
        tokens.append(bracket.decode() if bracket else word)
        if operand and not depth:
            ends = len(tokens)
    return _evaluated(tokens[:ends]) if ends else None


def _evaluated(tokens: list[str]) -> Expression:
    """Two stacks: operators wait until one that binds no more comes, values are (identifier or None, freedom)."""
    out = Expression(tokens)
    values: list[tuple[str | None, float]] = []
    waiting: list[str] = []

    def settle() -> None:
        operator, (b_name, b), (a_name, a) = waiting.pop(), values.pop(), values.pop()
        if operator == "with":
            values.append((f"{a_name} with {b_name}", min(1.0, a + EXCEPTION)))
            return
        out.labels += [n for n in (a_name, b_name) if n]
        values.append((None, max(a, b) if operator == "or" else min(a, b)))

    for n, token in enumerate(tokens):
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                settle()
            waiting.pop()
        elif token in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                settle()
            waiting.append(token)
        else:
            free = freedom(token)
            if free is None and not (n and tokens[n - 1] == "with"):
                out.known = False
            values.append((token, UNKNOWN if free is None else free))
    while waiting:
        settle()
    name, out.value = values[0]
    out.labels += [name] if name else []
    return out


def automaton(patterns) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for pattern, value in patterns:
        built.add_word(pattern, value)
    built.make_automaton()
    return built


class Scanner:
    """Both automata and what a text holds; positions are bytes, so texts are read as Latin-1."""

    def __init__(self, base: dict[str, str], phrases: dict[str, tuple[str, float]]) -> None:
        both = dict.fromkeys([*base, *phrases])
        self.words = automaton((f" {p} ", (p.count(" ") + 1, len(p), base.get(p), phrases.get(p))) for p in both)
        self.tags = automaton((t, (len(t), free)) for t, free in TAGS.items())

    def scan(self, text: bytes) -> tuple:
        words = text.translate(_TO_WORDS).split()
        line = b" " + b" ".join(words) + b" "
        starts, base_labels, found, seen, at = [], set(), {}, 0, 0
        best: dict[int, tuple[int, tuple[str, float]]] = {}
        for end, (_, size, base, phrase) in self.words.iter(line.decode("latin-1")):
            begin = end - size - 1
            if base:
                starts.append(begin)
                base_labels.add(base)
            if phrase and size > best.get(begin, (0,))[0]:
                best[begin] = (size, phrase)
        for _, (label, weight) in best.values():
            found[label] = max(found.get(label, 0.0), weight)
        free = [v for label in found if (v := freedom(label)) is not None]
        numbers = []
        for begin in sorted(starts):
            seen, at = seen + line.count(b" ", at, begin), begin
            numbers.append(seen)
        expressions = []
        low = text.lower()
        for end, (_, any_id) in self.tags.iter(low.decode("latin-1")):
            one = parsed(low, end + 1)
            if one and (any_id or one.known):
                expressions.append(" ".join(one.tokens))
                free.append(one.value)
                found |= dict.fromkeys(one.labels, TAG)
        for label in base_labels:
            found.setdefault(label, NAME)
        doubt = 1.0
        for label in sorted(found):
            doubt *= 1.0 - found[label]
        return len(words), len(numbers), min(numbers, default=None), max(numbers, default=None), ",".join(sorted(base_labels)), ",".join(sorted(found)), 1.0 - doubt, expressions, min(free, default=None)


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, freedom double"


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, phrases: dict[str, tuple[str, float]] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col and COLUMNS.

    Words are runs of letters, digits and whatever is beyond ASCII, A-Z
    lower-cased. n_base counts the places where a phrase of `base` stands,
    first_word and last_word are the smallest and largest word (from 0) at which
    one begins (null if none does). base_labels and labels are distinct, sorted
    and joined by commas, empty if there are none; labels also holds those of
    `phrases` (of phrases that begin at one word the longest) and of tagged
    expressions. score is 1 less the product of each label's doubt; expressions
    are the tagged ones in their order; freedom is what the strictest of all
    found licences allows (or takes the freer side, with adds a little), null
    if there is none. A null text is empty; null and repeated ids keep their
    rows, other columns play no part. Each text is read whole, once.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {COLUMNS}"
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, phrases)
        kinds = dict(zip(names, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.float64()]))
        for batch in batches:
            for part in byte_slices(batch):
                found = [scanner.scan(t.as_py() or b"") for t in part.column("text").cast(pa.binary())]
                columns = [pa.array([f[n] for f in found], kinds[name]) for n, name in enumerate(names)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", *names])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
