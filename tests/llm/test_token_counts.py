import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidewire.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  two  blanks ", "a b", "a\tb \n c", "tail ", " lead", "x  y", "\xa0a \xa0 b\xa0", "it's we'll I'd 'tis",
    "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "<|endoftext|> <|endo ftext|>", "ñandú, Straße. ÿ÷×", "日本 語 text", "1234 56,7 8a9b",
    "word.\nNext word", "\x1c \x1d", "a \x1cb", "  x", "é" * 5000, "é x́.", "th! !th ?! .. -- (a) |b|", "long " * 60_000,
]


def test_lengths_match_the_library():
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    way = C.counter(PATH)
    assert isinstance(way, C.ByteLevelSpans)
    assert way.lengths(pa.array(texts)).tolist() == want
    assert way.lengths(pa.array(texts[::-1])).tolist() == want[::-1]


def test_memory_of_spans_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 20)
    way = C.ByteLevelSpans(PATH)
    for k in range(5):
        texts = [f"alpha{j} beta, {k}" for j in range(15)]
        want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
        assert way.lengths(pa.array(texts)).tolist() == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_query(spark, name):
    rows = [(1, "one two", "x"), (2, None, "x"), (None, "", "y"), (2, None, "x"), (3, "word " * 2000, None)]
    got = C.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), public_tokenizers.path(name)).collect()
    by = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens > 0, r.over_limit) for r in got)
    assert by == [(0, 0, False, False), (1, 7, True, False), (2, 0, False, False), (2, 0, False, False), (3, 10000, True, True)]
    assert C.token_counts(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path(name)).collect() == []
