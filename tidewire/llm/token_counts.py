"""Token counts of whole texts, with nothing but lengths leaving the tasks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import byte_slices

#: Spans whose lengths a worker remembers, about 100 bytes each.
REMEMBERED = 400_000
#: Letters and marks of which a run is one pre-token of the byte-level pattern, whatever follows.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?&$#%*()|\-"
WORD_AND_MARKS = re.compile(f"( ?[{LETTERS}]+)([{MARKS}]*)")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


ALPHABET = byte_alphabet()


def as_alphabet(text: str) -> str:
    return text.encode().decode("latin-1").translate(ALPHABET)


class WholeTexts:
    """Lengths by encoding whole texts, for tokenizers of which no safe boundary is known."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            tokenizer = _loaded(path)
            self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        return np.array(self.encode(texts.to_pylist()), np.int64)


class ByteLevelSpans:
    """Lengths for byte-level BPE, by spans between safe boundaries.

    A boundary before a blank that stands between two non-blank characters is
    safe: the pre-tokenizer always begins a token there, and no special string
    contains a blank. So a text's length is the sum of its spans' lengths, a
    long text is never encoded in one piece, and a span met before costs one
    look-up. Where a span is a run of letters and then a run of marks, which
    the pattern always parts, each run is remembered by itself.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _loaded(path)
        self.known: dict[str, int] = {}

    def _learn(self, spans: list[str]) -> dict[str, int]:
        """Lengths of spans that aren't known yet."""
        runs: dict[str, int] = {}
        parts = {s: [p for p in m.groups() if p] for s in spans if (m := WORD_AND_MARKS.fullmatch(s))}
        tokenize = self.tokenizer.model.tokenize
        for p in {p for ps in parts.values() for p in ps}:
            runs[p] = self.known[p] if p in self.known else len(tokenize(as_alphabet(p)))
        found = {s: sum(runs[p] for p in ps) for s, ps in parts.items()}
        rest = [s for s in spans if s not in found]
        return runs | found | dict(zip(rest, map(len, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))

    def of(self, spans: list[str]) -> np.ndarray:
        known = self.known
        missing = [s for s in spans if s not in known]
        if missing:
            if len(known) + len(missing) > REMEMBERED:
                known = self.known = {}
                missing = spans
            known |= self._learn(missing)
        return np.fromiter(map(known.__getitem__, spans), np.int64, len(spans))

    def lengths(self, texts: pa.Array) -> np.ndarray:
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        opens = np.fromiter((bool(p) and not p[0].isspace() for p in pieces), bool, len(pieces))
        closes = np.fromiter((bool(p) and not p[-1].isspace() for p in pieces), bool, len(pieces))
        starts = np.zeros(len(codes), bool)
        starts[1:] = closes[codes[:-1]] & opens[codes[1:]]
        first = bounds[:-1]
        starts[first] = True
        lone = starts.copy()
        lone[:-1] &= starts[1:]
        simple = lone.copy()
        simple[first] = False
        lengths = np.zeros(len(codes), np.int64)
        used = np.unique(codes[simple])
        table = np.zeros(len(pieces), np.int64)
        table[used] = self.of([" " + pieces[k] for k in used.tolist()])
        lengths[simple] = table[codes[simple]]
        rest = np.flatnonzero(starts & ~simple)
        ends = np.append(np.flatnonzero(starts), len(codes))
        ends = ends[np.searchsorted(ends, rest, side="right")]
        is_first = np.zeros(len(codes), bool)
        is_first[first] = True
        spans = [
            ("" if begin else " ") + " ".join([pieces[c] for c in codes[a:b].tolist()])
            for a, b, begin in zip(rest.tolist(), ends.tolist(), is_first[rest].tolist())
        ]
        distinct = list(dict.fromkeys(spans))
        sizes = dict(zip(distinct, self.of(distinct).tolist()))
        lengths[rest] = [sizes[s] for s in spans]
        return np.add.reduceat(lengths, first) if len(first) else np.empty(0, np.int64)


@lru_cache(maxsize=4)
def _loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def counter(path: str) -> WholeTexts | ByteLevelSpans:
    """How lengths are found for the tokenizer at `path`; one for each worker, kept between tasks."""
    if path.endswith(".json"):
        with open(path) as file:
            said = json.load(file)
        way = said.get("pre_tokenizer") or {}
        plain = said.get("normalizer") is None and said["model"]["type"] == "BPE" and not said["model"].get("dropout")
        special = all(" " not in x["content"] and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in said["added_tokens"])
        if plain and special and way.get("type") == "ByteLevel" and way.get("use_regex") and not way.get("add_prefix_space"):
            return ByteLevelSpans(path)
    return WholeTexts(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row: the tokens that the library for `path` gives for the whole text.

    No begin, end or added special tokens, no truncation; special strings
    within a text are read as the library does by default. A null text counts
    as empty: no bytes, no tokens, not over the limit. Null and repeated ids
    keep their rows; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in byte_slices(batch):
                texts = pc.fill_null(part.column("text"), "")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(count.lengths(texts))], ["id", "n_bytes", "n_tokens"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    lengths = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return lengths.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
