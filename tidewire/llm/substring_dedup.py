"""Removal of word runs that repeat across documents, by difference-cover anchors.

A window is `length` consecutive words of one document. Modulo a period P the
cover D is a set such that any two residues can be shifted by one and the same
step below P to fall into D. So two equal windows, wherever they start, share
an anchor: a run of length - P + 1 words that begins at a cover position in
both. Hence:

1. Hash only the anchors at cover positions (6 of 31 words).
2. An anchor of two documents or more marks its place; nothing else goes on.
3. Extend: around the marked places hash every window, and keep per window the
   smallest document. Only these windows are hashed in full, by 128 bits.
4. Remove the words of windows whose smallest document isn't their own.

A batch settles by itself what repeats within it and sends one row per hash on:
a passage that a third of all documents share costs one row a batch in the
shuffle, not one a document. Settled anchors carry a hash of their own place,
so they spread evenly; settled windows travel as one list a document. Exact
copies of a document with a smaller id lose everything they have, and their
windows are its own: they are found by a 128-bit digest before step 1 and take
no part in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import counted, whole_ids, written
from .words import Words, byte_slices, split_words

#: Perfect difference sets by period: every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Bytes of text that meet in a batch to settle repeats.
BATCH_BYTES = 8 << 20


def period_for(length: int) -> int:
    """The longest period that leaves anchors of at least a third of a window."""
    return max((p for p in COVERS if length - p + 1 >= max(1, length // 3)), default=min(COVERS))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of word runs of equal length, from prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: np.uint64) -> None:
        n = len(hashes)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base)]))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
        self.prefix = np.concatenate([[np.uint64(0)], np.add.accumulate(hashes * back[:n])]) if n else np.zeros(1, np.uint64)

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.prefix[starts + length] - self.prefix[starts]) * self.power[starts])


def word_hashes(split: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    codes, words = split.coded()
    first = np.array([xxhash.xxh64_intdigest(w, 1) for w in words], np.uint64)
    return first[codes] if len(codes) else np.empty(0, np.uint64), mixed(first + np.uint64(7))[codes] if len(codes) else np.empty(0, np.uint64)


def _owners(split: Words) -> np.ndarray:
    return np.repeat(np.arange(len(split.offsets) - 1), split.counts)


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of (keys..., id): the smallest and the largest id with the same keys."""
    if not len(ids):
        return ids, ids
    order = np.lexsort((ids, *keys.T))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    last = np.append(first[1:], len(order)) - 1
    low, high = np.empty_like(ids), np.empty_like(ids)
    low[order], high[order] = ids[order][first][group], ids[order][last][group]
    return low, high


def _place(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key of its own for a row that is settled."""
    return mixed(ids.view(np.uint64) * BASES[0] + at.astype(np.uint64) + np.uint64(1))


class Cover:
    """The words of rows (id, text, text_key) that repeat a window of a document with a smaller id."""

    def __init__(self, length: int) -> None:
        self.length, self.period = length, period_for(length)
        self.anchor = length - self.period + 1
        self.member = np.isin(np.arange(self.period), COVERS[self.period])

    def anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, id, text_key, at, settled): anchors by place."""
        for batch in batches:
            for part in byte_slices(batch, limit=BATCH_BYTES):
                ids, texts = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_key"))
                split = split_words(part.column("text"))
                long = split.counts >= self.length
                owner = _owners(split)
                at = np.arange(len(owner)) - split.offsets[owner]
                hashes, _ = word_hashes(split)
                take = np.flatnonzero(long[owner] & self.member[at % self.period] & (at + self.anchor <= split.counts[owner]))
                keys = Rolling(hashes, BASES[0]).of(take, self.anchor)
                who, which, where = ids[owner[take]], texts[owner[take]], at[take]
                low, high = _least(keys[:, None], who)
                settled = low != high
                # Of what repeats in the batch, one row for each hash goes on under it, without a place.
                _, one = np.unique(keys[settled], return_index=True)
                known = np.flatnonzero(settled)
                columns = (
                    (keys[~settled], who[~settled], which[~settled], where[~settled], False),
                    (_place(who[known], where[known]), who[known], which[known], where[known], True),
                    (keys[known[one]], low[known[one]], np.zeros(len(one), np.int64), np.full(len(one), -1), True),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([c[0] for c in columns]).view(np.int64)),
                        pa.array(np.concatenate([c[1] for c in columns]), pa.int64()),
                        pa.array(np.concatenate([c[2] for c in columns]), pa.int64()),
                        pa.array(np.concatenate([c[3] for c in columns]), pa.int32()),
                        pa.array(np.concatenate([np.full(len(c[0]), c[4]) for c in columns])),
                    ],
                    ["key", "id", "text_key", "at", "settled"],
                )

    def windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, more, id, text_key, spot, settled): the windows around marked places, and in one list a row those that a smaller document of the batch has."""
        for batch in batches:
            for part in byte_slices(batch, limit=BATCH_BYTES):
                ids, texts = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_key"))
                split = split_words(part.column("text"))
                marks = part.column("marks")
                whose = np.repeat(np.arange(len(ids)), np.diff(marks.offsets.to_numpy()))
                spots = marks.flatten().to_numpy(zero_copy_only=False) + split.offsets[whose]
                owner = _owners(split)
                n = len(owner)
                reach = np.zeros(n + 1, np.int64)
                np.add.at(reach, np.maximum(spots - (self.period - 1), split.offsets[whose]), 1)
                np.add.at(reach, spots + 1, -1)
                at = np.arange(n) - split.offsets[owner]
                take = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & (at + self.length <= split.counts[owner]))
                first, second = word_hashes(split)
                keys = np.stack([Rolling(first, BASES[0]).of(take, self.length), Rolling(second, BASES[1]).of(take, self.length)], axis=1)
                doc = owner[take]
                spot = at[take].astype(np.int32)
                settled = _least(keys, ids[doc])[0] < ids[doc]
                lists, starts = np.unique(doc[settled], return_index=True)
                open_ = ~settled
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([keys[open_, 0], _place(ids[lists], starts)]).view(np.int64)),
                        pa.array(np.concatenate([keys[open_, 1], np.zeros(len(lists), np.uint64)]).view(np.int64)),
                        pa.array(np.concatenate([ids[doc[open_]], ids[lists]]), pa.int64()),
                        pa.array(np.concatenate([texts[doc[open_]], texts[lists]]), pa.int64()),
                        pa.array(np.concatenate([spot[open_], np.full(len(lists), -1)]), pa.int32()),
                        pa.array([None] * int(open_.sum()) + np.split(spot[settled], starts[1:])[: len(lists)], pa.list_(pa.int32())),
                    ],
                    ["key", "more", "id", "text_key", "spot", "settled"],
                )

    def removed(self, texts: DataFrame) -> DataFrame:
        """(id, text_key, spots): the windows to remove from a text.

        texts: (id long, text string, text_key long) with no null id and no copies, spread by id and key: all uses read that one shuffle.
        """
        anchors = texts.mapInArrow(self.anchors, "key long, id long, text_key long, at int, settled boolean")
        same = Window.partitionBy("key")
        marked = anchors.withColumn("low", F.min("id").over(same)).withColumn("high", F.max("id").over(same)).withColumn("known", F.max("settled").over(same))
        places = marked.where("at >= 0 and (known or low <> high)").groupBy("id", "text_key").agg(F.collect_list("at").alias("marks"))
        near = texts.join(places, ["id", "text_key"]).select("id", "text", "text_key", "marks")
        windows = near.mapInArrow(self.windows, "key long, more long, id long, text_key long, spot int, settled array<int>")
        low = F.min("id").over(Window.partitionBy("key", "more"))
        gone = windows.withColumn("low", low).where("settled is not null or low < id")
        spots = F.collect_list(F.coalesce("settled", F.array("spot"))).alias("spots")
        return gone.groupBy("id", "text_key").agg(spots).select("id", "text_key", F.flatten("spots").alias("spots"))


def _copied(docs: DataFrame, length: int) -> DataFrame:
    """(id, text_key) of texts (id, text, text_key) that a smaller id has just so, if they can hold `length` words."""
    own = written(docs.where(F.length("text") >= 2 * length - 1).select("id", "text_key", F.unhex(F.md5("text")).alias("digest")))
    again, _ = counted(own.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("digest", "low"))
    return counted(own.join(again, "digest").where("id > low").select("id", "text_key").distinct())[0]


def _keep(starts: np.ndarray, count: int, length: int) -> np.ndarray:
    edge = np.zeros(count + 1, np.int64)
    places = np.unique(starts)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + length, -1)
    return np.cumsum(edge[:-1]) == 0


def _cut(text: bytes, keep: np.ndarray) -> bytes:
    """The text without its removed words and the blanks after them."""
    begins = [m.start() for m in WORD.finditer(text)]
    out, from_ = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(text[from_ : begins[a]])
        from_ = begins[b] if b < len(begins) else len(text)
    return b"".join([*out, text[from_:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id_col, text_key, n_words, n_removed, kept_words, text): each row's text without the word windows that a smaller id has.

    Words are compared as they stand. Every window of `length` words whose word
    sequence also starts in a document with a smaller id loses all its words;
    windows are judged on the input. kept_words joins what is left by one
    space; `text` is the text with the removed words and the blanks after them
    cut out; text_key is Spark's xxhash64 of the text as it was. Null texts have no words and stay null; rows with a null id lose
    nothing and take nothing from others. Repeated rows are all returned, and
    different texts under one id each lose what smaller ids have, told apart by
    their text_key. Ids must be whole numbers. Other columns play no part.
    """
    cover = Cover(length)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An alias that renames nothing would hide from Spark that all uses of `texts` are one exchange.
    text = F.col(text_col).cast("string").alias("text") if (text_col, "string") not in docs.dtypes or text_col != "text" else F.col("text")
    docs = whole_ids(docs, id_col).select(F.col(id_col).cast("long").alias("id"), text).withColumn("text_key", F.xxhash64("text"))
    known = docs.where("id is not null")
    # Every use needs all three columns of the exchange, so that it stays one. An id of many texts is spread by their keys.
    key = ["id", "text_key"]
    copies = _copied(known, length).withColumn("copied", F.lit(True))
    texts = known.repartition(parts, *key).join(copies, key, "left").select("id", "text", "text_key", F.coalesce("copied", F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                counts, removed, kept, left = [], [], [], []
                split = split_words(part.column("text"))
                originals, copies, spots = (part.column(c) for c in ("text", "copy", "spots"))
                for i, joined in enumerate(split.joined()):
                    n, gone = int(split.counts[i]), spots[i].values
                    gone = np.empty(0, np.int32) if gone is None else gone.to_numpy(zero_copy_only=False)
                    counts.append(n)
                    if not len(gone) and not (copies[i].as_py() and n >= length):
                        removed.append(0)
                        kept.append(joined)
                        left.append(originals[i].as_py())
                        continue
                    keep = np.zeros(n, bool) if copies[i].as_py() else _keep(gone, n, length)
                    removed.append(int(n - keep.sum()))
                    words = joined.split(b" ")
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(keep).tolist()]))
                    left.append(_cut(originals[i].as_py().encode(), keep).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_key"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(left, pa.string())],
                    ["id", "text_key", "n_words", "n_removed", "kept_words", "text"],
                )

    marked = texts.join(cover.removed(texts.where("not copy").select("id", "text", "text_key")), key, "left").select("id", "text", "text_key", "copy", "spots")
    marked = marked.union(docs.where("id is null").select("id", "text", "text_key", F.lit(False), F.lit(None).cast("array<int>")))
    return marked.mapInArrow(run, "id long, text_key long, n_words long, n_removed long, kept_words string, text string").withColumnRenamed("id", id_col)
