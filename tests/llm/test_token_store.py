import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidewire.llm import token_store as T

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "It's <|endoftext|> a<|endoftext|>b <|startoftext|>", "ÀÉ ÿ Ÿ İI ßS", "éa ́x", "Σίσυφος ΣΑΣ Σ", "12 3a,b.c!! ..x",
    "\xa0a\xa0b  c", "日本 語", "\x1ca \x1d", "(Word) |pipe| **x** #tag &&&", "A" * 3000, "word " * 30_000, "'S 'll X'RE", "x​y", "ﬁne Ǆ",
]


def want(texts):
    return [[*e.ids, 2] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_match_the_library():
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    encode = T.encoder(PATH)
    assert isinstance(encode, T.WordIds)
    assert [x.tolist() for x in encode.encode(pa.array(texts), 2)] == want(texts)
    assert [x.tolist() for x in encode.encode(pa.array(texts))] == [x[:-1] for x in want(texts)]
    assert [x.tolist() for x in T.WholeIds(PATH).encode(pa.array(ODD), 2)] == want(ODD)
    assert encode.encode(pa.array([], pa.string()), 2)[0].tolist() == []


class Counting:
    """A tokenizer that notes what it is asked."""

    def __init__(self, real):
        self.real, self.asked, self.model = real, [], self

    def tokenize(self, run):
        self.asked.append(run)
        return self.real.model.tokenize(run)

    def encode_batch_fast(self, words, **options):
        self.asked += words
        return self.real.encode_batch_fast(words, **options)


def test_spellings_of_a_known_run_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 20)
    encode = T.WordIds(PATH)
    encode.tokenizer = seen = Counting(encode.tokenizer)
    for written in (str, str.upper, str.title):
        text = " ".join(written(w) + m for w in ("word", "tone", "lake") for m in ("", ".", ",", "!!", "&&&")) + " x1"
        assert [x.tolist() for x in encode.encode(pa.array([text, None]), 2)] == want([text, None])
    assert sorted(seen.asked) == sorted(["word", "tone", "lake", ".", ",", "!!", "&&&", "x1"])


def test_ids_match_when_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    encode = T.WordIds(PATH)
    assert [encode.encode(pa.array([t, t, None]), 2)[1].tolist() for t in ODD] == want(ODD)
    assert len(encode.bounds) < 60


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_round_trip(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_BYTES", block)
    texts = ODD + [None, "repeat", "repeat"] + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:60]
    ids = [*range(100, 100 + len(texts) - 2), 7, 7]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], "doc_id long, text string, start string")
    store = str(tmp_path / "store")
    T.write_store(frame.repartition(3), store, PATH)
    got = T.stored_digests(spark, store).orderBy("start").collect()
    rows = sorted(zip(ids, texts, want(texts)), key=lambda x: (x[0], x[1] or ""))
    expected, start = [], 0
    for i, _, w in rows:
        expected.append((i, start, len(w), T.crc32_of(w)))
        start += len(w)
    assert [r.start for r in got] == [e[1] for e in expected]
    assert [tuple(r) for r in got] == expected
    assert T.read_document(spark, store, 103) == want([ODD[3]])[0]
    assert T.read_document(spark, store, 5) is None


def test_long_texts_and_repeated_ids_leave_the_dictionary_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE_TEXT", 100)
    rows = [(k, "word " * 10 + str(k)) for k in range(40)] + [(k, "long " * 1000) for k in range(100, 140)] + [(5, "other words")] * 3
    docs = spark.createDataFrame(rows, "id long, text string")
    short = docs.where("length(text) < 100")
    assert T.dictionary_for(docs, PATH, 2) == T.dictionary_for(short, PATH, 2) != b""


def test_ids_must_be_whole_numbers(spark, tmp_path):
    with pytest.raises(TypeError):
        T.write_store(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path / "s"), PATH)


def test_empty_table(spark, tmp_path):
    store = str(tmp_path / "store")
    T.write_store(spark.createDataFrame([], "doc_id long, text string"), store, PATH)
    assert T.stored_digests(spark, store).collect() == []
