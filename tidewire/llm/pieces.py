"""SentencePiece ids of whole texts, each piece with its byte span in the original text.

Normalisation is done here: the longest prefix that the model's compiled
character map knows is replaced, and every normalised byte records where in the
text it came from. The normalised text is cut where a meta blank (U+2581)
follows another character: a BPE vocabulary in which no piece has one there
never merges across such a cut, so segments can be encoded by themselves and
remembered. Ids are the library's; spans are the pieces' lengths projected
through the alignment. Models or texts that don't allow this are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import byte_slices

META = "▁"
#: Segments whose ids a worker remembers.
REMEMBERED = 250_000
SEGMENT = re.compile(f"{META}+[^{META}]*|^[^{META}]+")


class CharacterMap:
    """Longest-prefix replacement through a compiled map: a double-array trie of UTF-8 prefixes, then the replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest known prefix at `at`, and what replaces it; (0, b"") if none is known."""
        units, found = self.units, (0, b"")
        if not units:
            return found
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)])
        return found


class Normalised(NamedTuple):
    text: bytes
    #: For each normalised byte, and the end, the byte of the original that it starts at.
    source: np.ndarray


class Pieces:
    """Ids and spans by one model."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        said = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            said.ParseFromString(file.read())
        self.rules = said.normalizer_spec
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        names = [p.piece for p in said.pieces]
        kinds = [p.type for p in said.pieces]
        user = {n for n, k in zip(names, kinds) if k == 4}
        inner = any(META in n.lstrip(META) for n, k in zip(names, kinds) if k in (1, 4))
        suffix = said.trainer_spec.treat_whitespace_as_suffix
        #: Segments may be encoded by themselves.
        self.plain = not self.map.units and self.rules.add_dummy_prefix and self.rules.escape_whitespaces and not self.rules.remove_extra_whitespaces
        self.apart = self.plain and said.trainer_spec.model_type == 2 and said.trainer_spec.byte_fallback and not inner and not user and not suffix and META in names
        #: Normalised bytes of each piece; a byte piece stands for one, a control piece for none.
        self.sizes = np.array([0 if k == 3 else 1 if k == 6 else len(n.encode()) for n, k in zip(names, kinds)], np.int64)
        self.spelled = [b"" if k == 3 else bytes([int(n[1:-1], 16)]) if k == 6 else n.encode() for n, k in zip(names, kinds)]
        self.known: dict[str, list[int]] = {}

    def normalise(self, text: str) -> Normalised:
        """The library's normal form of a text, aligned with its bytes.

        Without a character map a character stands for itself. Blanks become
        meta blanks, runs shrink to one and edges go where the model says so,
        and the dummy prefix comes first.
        """
        raw = text.encode()
        out, source, at = [], [], 0
        strip = self.rules.remove_extra_whitespaces
        meta = META.encode() if self.rules.escape_whitespaces else b" "
        chars = self._chars(raw)
        if strip:
            while chars and chars[0][0] == b" ":
                at = chars.pop(0)[2]
        if chars and self.rules.add_dummy_prefix:
            out.append(meta)
            source += [chars[0][1]] * len(meta)
        blank = strip
        for new, begin, stop in chars:
            if strip and blank and new[:1] == b" ":
                new = new.lstrip(b" ")
            if new:
                blank = new[-1:] == b" "
                new = new.replace(b" ", meta)
                out.append(new)
                source += range(begin, stop) if new == raw[begin:stop] else [begin] * len(new)
            at = stop
        joined = b"".join(out)
        if strip:
            while joined.endswith(meta):
                joined = joined[: -len(meta)]
                at = source[len(joined)]
        return Normalised(joined, np.array([*source[: len(joined)], at], np.int64))

    def _plain_form(self, text: str) -> Normalised:
        """`normalise` for a model without a map that keeps all blanks, a text at a time: only blanks change."""
        raw, meta = text.encode(), META.encode()
        if not raw:
            return Normalised(raw, np.zeros(1, np.int64))
        source = np.repeat(np.arange(len(raw)), np.where(np.frombuffer(raw, np.uint8) == 32, len(meta), 1))
        return Normalised(meta + raw.replace(b" ", meta), np.concatenate([np.zeros(len(meta), np.int64), source, [len(raw)]]))

    def _chars(self, raw: bytes) -> list[tuple[bytes, int, int]]:
        """(replacement, begin, end) of each longest known prefix, or else of each character."""
        out, at = [], 0
        while at < len(raw):
            size, new = self.map.longest(raw, at)
            if not size:
                size = 1
                while at + size < len(raw) and raw[at + size] & 0xC0 == 0x80:
                    size += 1
                new = raw[at : at + size]
            out.append((new, at, at + size))
            at += size
        return out

    def of(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments, each of which begins with a meta blank."""
        missing = [s for s in segments if s not in self.known]
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.known, missing = {}, segments
            # The library puts the first meta blank before what it encodes, unless that is nothing.
            self.known |= zip(missing, self.model.encode([s[1:].replace(META, " ") for s in missing], num_threads=1))
            self.known[META] = [self.model.piece_to_id(META)]
        return list(map(self.known.__getitem__, segments))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The library's ids of each text (null: empty), begin and end included."""
        texts = pc.fill_null(texts, "")
        if not self.apart:
            return [np.array([self.begin, *x, self.end], np.uint32) for x in self.model.encode(texts.to_pylist(), num_threads=1)]
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        odd = np.fromiter((not w or META in w for w in words), bool, len(words))
        # A text with blank runs or meta blanks of its own is cut by itself.
        apart = np.add.reduceat(odd[codes], bounds[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        table = self.of([META + w for w in words])
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        flat = np.fromiter((i for x in table for i in x), np.uint32, int(sizes.sum()))
        start = np.cumsum(sizes) - sizes
        each = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        picked = flat[np.repeat(start[codes] - upto[:-1], each) + np.arange(upto[-1])]
        ends = upto[bounds]
        out = []
        for i, other in enumerate(apart.tolist()):
            if not other:
                out.append(np.concatenate([[self.begin], picked[ends[i] : ends[i + 1]], [self.end]]).astype(np.uint32))
            else:
                text = texts[i].as_py()
                cut = self.of(SEGMENT.findall(META + text.replace(" ", META))) if text else []
                out.append(np.array([self.begin, *(k for s in cut for k in s), self.end], np.uint32))
        return out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end bytes in the original text of each piece; begin and end pieces get the text's ends."""
        form = self._plain_form(text) if self.plain else self.normalise(text)
        if self.apart and b"".join(map(self.spelled.__getitem__, ids.tolist())) != form.text:
            raise ValueError("pieces do not spell the normal form")
        source = form.source
        ends = np.cumsum(self.sizes[ids])
        begins, ends = source[np.minimum(ends - self.sizes[ids], len(source) - 1)], source[np.minimum(ends, len(source) - 1)]
        if self.apart and not (begins[0] == 0 and ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all()):
            raise ValueError("spans do not cover the text")
        return begins, ends


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model at `path`; one for each worker, kept between tasks."""
    return Pieces(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, keep: tuple[str, ...] = (), hashed: bool = False) -> DataFrame:
    """(id_col, ids, decoded), with `spans` (begins, ends) or, `hashed`, spans_sha256, and the columns `keep` of docs, for every row.

    ids: begin id, the library's ids of the whole text without sampling, end
    id, as little-endian unsigned 32-bit integers in one binary value. decoded:
    what the library makes of these ids. begins and ends: each piece's bytes in
    the original UTF-8 text; spans_sha256: SHA-256 of all begins and then all
    ends as little-endian 32-bit integers. A null text counts as empty. Null and repeated
    ids keep their rows; other columns play no part.
    """
    more = [("spans_sha256", "string")] if spans and hashed else [("begins", "array<int>"), ("ends", "array<int>")] if spans else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way = pieces(path)
        for batch in batches:
            for part in byte_slices(batch):
                ids = way.ids(part.column("text"))
                columns = [
                    part.column("id"),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    pa.array([way.model.decode(x.tolist()) for x in ids], pa.string()),
                ]
                if spans:
                    both = [way.spans(t or "", x) for t, x in zip(part.column("text").to_pylist(), ids)]
                    if hashed:
                        columns.append(pa.array([hashlib.sha256(np.concatenate(b).astype("<u4").tobytes()).hexdigest() for b in both], pa.string()))
                    else:
                        columns += [pa.array([b[k] for b in both], pa.list_(pa.int32())) for k in (0, 1)]
                columns += [part.column(f"keep{k}") for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns, names)

    kept = [(f"keep{k}", docs.schema[c].dataType.simpleString()) for k, c in enumerate(keep)]
    columns = [("id", docs.schema[id_col].dataType.simpleString()), ("ids", "binary"), ("decoded", "string"), *more, *kept]
    names = [n for n, _ in columns]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)))
    out = texts.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in columns))
    return out.withColumnsRenamed({"id": id_col} | {f"keep{k}": c for k, c in enumerate(keep)})


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), spans: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of `encoded`, with `spans` spans_sha256, and the columns `keep` of docs."""
    return encoded(docs, path, id_col, text_col, spans, keep, hashed=True).select(
        id_col,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["spans_sha256"] if spans else []),
        *keep,
    )
