"""Token-id files: per-document zstandard frames under one shared dictionary.

A store is a folder with two Parquet tables, so that Spark writes and reads it
through any file system:

* `dictionary`: one row (hash, width, end_id, dictionary);
* `blocks`: rows of about `BLOCK_BYTES` of frames in ascending id order:
  (shard, block, first_id, last_id, before, dictionary_hash, ids, offsets,
  counts, payload). payload[offsets[i]:offsets[i + 1]] is the frame of ids[i]:
  counts[i] token ids, little-endian, `width` bytes each. `before` counts the
  token ids of the shard's earlier blocks.

One document is read by the footer's id ranges, its block's offsets and its
own frame alone (`read_document`).
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import counted, whole_ids
from .token_counts import LETTERS, MARKS, as_alphabet
from .words import byte_slices, split_words

BLOCK_BYTES = 1 << 20
#: Bytes of text encoded at a time: the more, the fewer words are looked up again.
ENCODED_BYTES = 8 << 20
#: Runs and words whose ids a worker remembers, beyond which it forgets them before the next texts.
REMEMBERED = 500_000
#: Documents that the dictionary is trained on, and its size. Every document is encoded and written.
SAMPLE_DOCS, DICTIONARY_BYTES = 400, 64 << 10
#: Bytes of the longest text that the dictionary is trained on.
SAMPLE_TEXT = 1 << 18
LEVEL = 3
#: Largest table of shards (some 20 bytes each) that is broadcast.
SHARDS = 100_000
BLOCKS = (
    "shard int, block int, first_id long, last_id long, before long, dictionary_hash string, "
    "ids array<long>, offsets array<int>, counts array<int>, payload binary"
)


class WordIds:
    """Ids of texts by their words, for a tokenizer that drops white space and never looks across it.

    A word that is a run of letters and then a run of marks is two pre-tokens,
    each given to the tokenizer's model; any other word is encoded whole. Runs
    and such words are remembered, and not every spelling of a run with its
    capitals and marks. All ids found lie in one flat array, of which a run or
    word has a row number; row 0 is empty.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.runs: dict[str, int] = {"": 0}
        self.others: dict[str, int] = {}
        self.flat, self.bounds = array("I"), array("q", [0, 0])

    def _run_ids(self, runs: list[str]) -> Iterator[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        return ([t.id for t in tokenize(r if r.isascii() else as_alphabet(r))] for r in runs)

    def _other_ids(self, words: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))

    def _rows(self, known: dict[str, int], strings: pa.Array, ids_of: Callable[[list[str]], Iterator[list[int]]]) -> np.ndarray:
        """The row number of each string; those that `known` lacks are learned."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [s for s in distinct if s not in known]
        for s, ids in zip(missing, ids_of(missing)):
            known[s] = len(self.bounds) - 1
            self.flat.extend(ids)
            self.bounds.append(len(self.flat))
        rows = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        return rows[coded.indices.to_numpy(zero_copy_only=False)]

    def of(self, words: pa.Array) -> np.ndarray:
        """The row numbers of each word, two to a word."""
        if len(self.bounds) > REMEMBERED:
            self._forget()
        parts = pc.extract_regex(words, f"^(?P<letters>[{LETTERS}]+)(?P<marks>[{MARKS}]*)$")
        simple = parts.is_valid()
        runs, at = parts.filter(simple), simple.to_numpy(zero_copy_only=False)
        rows = np.zeros((len(words), 2), np.int64)
        rows[at, 0] = self._rows(self.runs, pc.utf8_lower(runs.field("letters")), self._run_ids)
        rows[at, 1] = self._rows(self.runs, runs.field("marks"), self._run_ids)
        rows[~at, 0] = self._rows(self.others, words.filter(pc.invert(simple)), self._other_ids)
        return rows

    def encode(self, texts: pa.Array, end: int | None = None) -> list[np.ndarray]:
        """The ids of each text (null: empty), and the end id after them."""
        split = split_words(texts)
        coded = split.words.dictionary_encode()
        codes, rows = coded.indices.to_numpy(zero_copy_only=False), self.of(coded.dictionary)
        bounds, flat = np.array(self.bounds, np.int64), np.array(self.flat, np.uint32)
        flat, bounds = _picked(flat, bounds[rows.ravel()], bounds[rows.ravel() + 1])
        begin, stop = bounds[:-1:2], bounds[2::2]
        if end is not None:
            codes = np.insert(codes, split.offsets[1:], len(rows))
            begin, stop, flat = np.append(begin, len(flat)), np.append(stop, len(flat) + 1), np.append(flat, np.uint32(end))
        picked, upto = _picked(flat, begin[codes], stop[codes])
        cuts = split.offsets + (np.arange(len(split.offsets)) if end is not None else 0)
        return np.split(picked, upto[cuts[1:-1]])


def _picked(flat: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[begin[i]:stop[i]] of every i, one after the other, and where each begins and the last ends."""
    upto = np.concatenate([[0], np.cumsum(stop - begin)])
    return flat[np.repeat(begin - upto[:-1], stop - begin) + np.arange(upto[-1])], upto


class WholeIds:
    """Ids by encoding whole texts, for any other tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def encode(self, texts: pa.Array, end: int | None = None) -> list[np.ndarray]:
        last = [] if end is None else [end]
        coded = self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)
        return [np.array(e.ids + last, np.uint32) for e in coded]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordIds | WholeIds:
    """The encoder for the tokenizer at `path`; one for each worker, kept between tasks."""
    import json

    with open(path) as file:
        said = json.load(file)
    steps = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
    ways = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = len(ways) == 2 and ways[0]["type"] == "Split" and ways[0]["behavior"] == "Removed" and ways[0]["invert"] and ways[1]["type"] == "ByteLevel"
    blank = any(x in (ways[0]["pattern"]["Regex"] if drops else "") for x in (r"\s+", r"\s*", "(?", r"\S"))
    whole = any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in said["added_tokens"])
    return WordIds(path) if steps == ["NFC", "Replace", "Lowercase"] and drops and not blank and not whole else WholeIds(path)


def dictionary_for(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A zstandard dictionary trained on the serialized ids of at most SAMPLE_DOCS documents of at most SAMPLE_TEXT bytes each.

    They are those with the least hash of their ids, so the sample fits the
    driver whatever the texts. With too few samples to train on, the samples
    themselves are the (raw) dictionary.
    """
    docs = docs.where((F.octet_length("text") <= SAMPLE_TEXT) & F.col("id").isNotNull())
    chosen = sorted({r.id for r in docs.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in byte_slices(batch):
                kind = np.dtype("<u2" if encode.width == 2 else "<u4")
                ids = [x.astype(kind).tobytes() for x in encode.encode(part.column("text"), end_id)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    sample = docs.where(F.col("id").isin(chosen)).mapInArrow(run, "id long, ids binary").dropDuplicates(["id"]) if chosen else None
    parts = [bytes(r.ids) for r in sample.orderBy("id").collect()] if sample is not None else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_store(docs: DataFrame, out: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends `end_id` and writes the store in ascending id order.

    Null texts count as empty: their only id is the end id. Null ids come
    first; rows of one id follow each other by text. An empty table makes an
    empty store. Ids must be whole numbers.
    """
    spark = docs.sparkSession
    docs = whole_ids(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dictionary = dictionary_for(docs, path, end_id)
    digest = f"{xxhash.xxh64_intdigest(dictionary):016x}"
    width = encoder(path).width
    spark.createDataFrame([(digest, width, end_id, dictionary)], "hash string, width int, end_id int, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path), TaskContext.get().partitionId()
        kind = np.dtype("<u2" if width == 2 else "<u4")
        shared = _codec(dictionary)
        if shared:
            shared.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        ids, counts, frames, size, block, before = [], [], [], 0, 0, 0

        def full() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int32)
            known = [i for i in ids if i is not None]
            row = {
                "shard": shard, "block": block, "first_id": min(known, default=None), "last_id": max(known, default=None), "before": before,
                "dictionary_hash": digest, "ids": ids, "offsets": offsets.tolist(), "counts": counts, "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema(
            [("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("before", pa.int64()), ("dictionary_hash", pa.string()),
             ("ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("payload", pa.binary())]
        )
        for batch in batches:
            for part in byte_slices(batch, limit=ENCODED_BYTES):
                for i, x in zip(part.column("id").to_pylist(), encode.encode(part.column("text"), end_id)):
                    frame = pack.compress(x.astype(kind).tobytes())
                    ids.append(i)
                    counts.append(len(x))
                    frames.append(frame)
                    size += len(frame)
                    if size >= BLOCK_BYTES:
                        yield full()
                        before, block = before + sum(counts), block + 1
                        ids, counts, frames, size = [], [], [], 0
        if ids:
            yield full()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "text")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{out}/blocks")


def _dictionary(spark: SparkSession, store: str) -> tuple[str, int, bytes]:
    row = spark.read.parquet(f"{store}/dictionary").first()
    return row.hash, row.width, bytes(row.dictionary)


def _ids(frame: bytes, unpack: zstandard.ZstdDecompressor, width: int) -> np.ndarray:
    return np.frombuffer(unpack.decompress(frame), "<u2" if width == 2 else "<u4").astype("<u4")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids as little-endian unsigned 32-bit integers, and how many ids precede it in the store."""
    digest, width, dictionary = _dictionary(spark, store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError(f"block {row['shard']}/{row['block']} was written with another dictionary")
                cut, payload = row["offsets"], row["payload"]
                ids = [_ids(payload[a:b], unpack, width) for a, b in zip(cut, cut[1:])]
                begin = row["before"] + np.cumsum([0, *row["counts"][:-1]])
                columns = [pa.array([row["shard"]] * len(ids), pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(begin, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "begin", "ids"])

    blocks = spark.read.parquet(f"{store}/blocks")
    # One row for each shard, of which there are as many as files: their running total is the only global order.
    totals = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    bases = totals.selectExpr("shard", "coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0) as base")
    bases, _ = counted(bases, SHARDS)
    documents = blocks.mapInArrow(run, "shard int, id long, begin long, ids binary")
    return documents.join(bases, "shard").select(F.col("id").alias("doc_id"), (F.col("base") + F.col("begin")).alias("start"), "ids")


def read_document(spark: SparkSession, store: str, doc_id: int) -> list[int] | None:
    """One document's ids, from its own frame; None if it isn't in the store."""
    digest, width, dictionary = _dictionary(spark, store)
    at = F.array_position("ids", F.lit(doc_id)).cast("int")
    where = spark.read.parquet(f"{store}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & (at > 0))
    begin, end = F.element_at("offsets", at), F.element_at("offsets", at + 1)
    row = where.select("dictionary_hash", F.substring("payload", begin + 1, end - begin).alias("frame")).first()
    if row is None:
        return None
    if row.dictionary_hash != digest:
        raise ValueError("the block was written with another dictionary")
    return _ids(bytes(row.frame), zstandard.ZstdDecompressor(dict_data=_codec(dictionary)), width).tolist()


def stored_digests(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store's documents."""
    ids = read_store(spark, store)
    return ids.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    """What ids_crc32 holds for these ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
