import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tidewire.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "a", " a", "a ", "a  b   c    d     e", "▁", "x▁ y", "a▁b", "▁ ▁", "<s> </s> <unk>", "<0x41>", "tab\tnew\nline \n x", "日本語 テキスト 😀 😀",
    "ñandú Straße", "\xa0a \xa0b", "é combining", "a" * 500, "word " * 20_000, "1234 5,6", "\x00 \x01", " " * 40 + "x",
]


def texts():
    return ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()


def test_ids_match_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = model.encode(texts(), add_bos=True, add_eos=True)
    way = P.Pieces(PATH)
    assert way.apart
    assert [x.tolist() for x in way.ids(pa.array(texts()))] == want
    way.apart = False
    assert [x.tolist() for x in way.ids(pa.array(ODD))] == want[: len(ODD)]


def test_spans_are_the_pieces_bytes():
    way = P.Pieces(PATH)
    for text, ids in zip(texts(), way.ids(pa.array(texts()))):
        raw = text.encode()
        begins, ends = way.spans(text, ids)
        assert begins[0] == ends[0] == 0 and ends[-1] == len(raw)
        assert (begins[1:] == ends[:-1]).all()
        for k, (b, e) in enumerate(zip(begins.tolist(), ends.tolist())):
            piece = way.model.id_to_piece(int(ids[k]))
            if len(text) < 200 and not piece.startswith("<") and P.META not in text:
                assert raw[b:e] == piece.encode()[3 if k == 1 else 0 :].replace(P.META.encode(), b" ")


def test_plain_spans_agree_with_the_alignment():
    way = P.Pieces(PATH)
    for text in [t for t in ODD if len(t) < 1000]:
        ids = way.ids(pa.array([text]))[0]
        fast = way.spans(text, ids)
        way.plain = False
        slow = way.spans(text, ids)
        way.plain = True
        assert [x.tolist() for x in fast] == [x.tolist() for x in slow]


def test_normal_form_by_a_compiled_map():
    # The library builds its own maps; none is trained.
    for rule in ("nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf"):
        for strip in (True, False):
            for dummy in (True, False):
                made = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=strip, add_dummy_prefix=dummy, escape_whitespaces=True)
                said = sentencepiece_model_pb2.ModelProto()
                said.ParseFromString(made.serialized_model_proto())
                way = P.Pieces.__new__(P.Pieces)
                way.rules = said.normalizer_spec
                way.map = P.CharacterMap(way.rules.precompiled_charsmap)
                assert way.map.units
                for text in ["ﬁne Ⅷ ｆｕｌｌ", "①②  x  ", "  a\tb ", "Å Å é", "", "   ", "㍿ ½", "plain", "İ ß", "한글 가"]:
                    got = way.normalise(text)
                    assert got.text.decode() == made.normalize(text), (rule, strip, dummy, text)
                    assert len(got.source) == len(got.text) + 1
                    assert (np.diff(got.source) >= 0).all() and got.source[-1] <= len(text.encode())


def test_query(spark):
    rows = [(1, "one two", "x"), (2, None, "y"), (2, None, "y"), (None, "", None), (3, "long text " * 5000, "z")]
    got = P.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for d, t, _ in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    full = P.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH)
    assert {len(r.begins) * 4 == len(r.ids) for r in full.collect()} == {True}
    assert P.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_spans_of_byte_pieces_agree_with_the_alignment():
    way = P.Pieces(PATH)
    for text in ["𓀀", "a 𓀀𓁀 ▁b", "▁ 𓀀 "]:
        ids = way.ids(pa.array([text]))[0]
        fast = way.spans(text, ids)
        assert fast[1][-1] == len(text.encode())
        way.plain = False
        slow = way.spans(text, ids)
        way.plain = True
        assert [x.tolist() for x in fast] == [x.tolist() for x in slow]


def test_registered_query_has_the_spans_of_every_text(spark, tmp_path):
    from tidewire.llm.queries import op6_pieces

    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    way = P.Pieces(PATH)
    want = []
    for d, t in rows:
        both = way.spans(t or "", way.ids(pa.array([t], pa.string()))[0])
        want.append((d, hashlib.sha256(np.concatenate(both).astype("<u4").tobytes()).hexdigest()))
    got = [(r.doc_id, r.spans_sha256) for r in op6_pieces(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pieces_of_another_text_are_refused():
    way = P.Pieces(PATH)
    with pytest.raises(ValueError):
        way.spans("one tow", way.ids(pa.array(["one two"]))[0])
