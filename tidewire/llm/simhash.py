"""SimHash near-duplicates: fingerprints, exact radius search and classes.

1. `fingerprints` reads whole texts in tasks and keeps one row a document.
2. Equal fingerprints collapse to one representative before any search.
3. Candidates meet in buckets. With a radius r the 64 bits are cut into k
   blocks: two fingerprints within r bits agree in at least k - r blocks
   (pigeonhole), so buckets for every choice of k - r blocks lose no pair. Buckets
   of over `TILE` fingerprints are cut into tiles of chunk pairs, so no bucket
   meets in one task.
4. Within a tile distances are bit-sliced (bitslice.py); a tile gives only a
   spanning forest of its links, never all its pairs.
5. Components of those links are found in tables.

`similar_classes` goes the same way with 128-bit fingerprints of shingle sets;
its tiles check each pair exactly and give a spanning forest of sure links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitslice import close_pairs, close_runs, forest
from .components import connected_components
from .shared import whole_ids, written
from .words import byte_slices, split_words

#: Most fingerprints of a chunk; a tile holds two chunks of one bucket at most.
TILE = 2048
#: Most shingles of a chunk where shingle sets travel with the rows (8 MB), unless one text alone has more.
TILE_SHINGLES = 1 << 20
#: Blocks of 64 pairs looked at in one go where every pair counts.
RUN_BLOCKS = 1 << 14
#: Blocks beyond the radius: two of them leave buckets of 21 bits in 15 choices for a radius of 4.
SPARE_BLOCKS = 2
#: Largest table of hot buckets that is broadcast: at 20 bytes a row, 1 MB.
HOT_ROWS = 50_000
MIX = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(joined: bytes, lengths: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words of a text given with one space between words; the whole text if it has fewer."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(lengths) <= k:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(ends) - k + 1].tolist()
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other hashes of the same shingles; number 0 leaves them as they are."""
    if not number:
        return hashes
    x = hashes + np.uint64(MIX[number])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, repeats: bool = True, raw: bool = False) -> DataFrame:
    """(id, f0.., text_hash, size): `words` 64-bit SimHashes of every whole text, XXH64 of its word sequence, and the shingles counted.

    With `raw`, text_key comes too, the 64-bit hash of the text as it stands (of null, if it is null).

    A-Z count as a-z. A shingle is `shingle` words joined by spaces, repeats
    included unless `repeats` is false; a text with fewer words is one shingle; a null, empty or blank
    text has fingerprint 0. A bit is set if over half of the hashes have it.
    Rows with a null id stay. One row comes out for each row that goes in.
    """
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                split = split_words(part.column("text"), lower=True)
                found: list[list[int]] = [[] for _ in names]
                whole, sizes = [], []
                for i, joined in enumerate(split.joined()):
                    hashes = shingle_hashes(joined, split.lengths[split.offsets[i] : split.offsets[i + 1]], shingle)
                    if not repeats:
                        hashes = np.unique(hashes)
                    for k, got in enumerate(found):
                        got.append(majority(remixed(hashes, k)))
                    whole.append(xxhash.xxh64_intdigest(joined, 42))
                    sizes.append(len(hashes))
                columns = [part.column("id"), *(pa.array(_signed(x)) for x in (*found, whole)), pa.array(sizes, pa.int32()), *([part.column("text_key")] if raw else [])]
                yield pa.RecordBatch.from_arrays(columns, ["id", *names, "text_hash", "size", *(["text_key"] if raw else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), *([F.xxhash64(text).alias("text_key")] if raw else []))
    return texts.mapInArrow(run, f"id {kind}, {', '.join(f'{x} long' for x in names)}, text_hash long, size int{', text_key long' if raw else ''}")


def block_choices(blocks: int, radius: int) -> list[int]:
    """Masks of 64 bits, one for every choice of blocks - radius blocks out of `blocks`."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(masks, blocks - radius)]


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value)


def _tiles(keyed: DataFrame, keep: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Adds (key, lo, hi) tiles: buckets of one row go, large ones become pairs of chunks, each row in every pair that has its chunk.

    A bucket is also large if its rows' `weight` adds up to over TILE_SHINGLES. Columns `keep` stay.
    """
    chunks = F.ceil(F.count("*") / TILE)
    if weight:
        chunks = F.greatest(chunks, F.ceil(F.sum(weight) / TILE_SHINGLES))
    sizes = keyed.groupBy("key").agg(chunks.cast("int").alias("chunks"))
    hot = written(sizes.where("chunks > 1"))
    few = hot.count()
    if few:
        keyed = keyed.join(F.broadcast(hot) if few <= HOT_ROWS else hot, "key", "left")
    else:
        keyed = keyed.withColumn("chunks", F.lit(None).cast("int"))
    chunk = F.pmod(F.xxhash64("f0", "id"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, chunk).alias("lo"), F.greatest(c, chunk).alias("hi")))
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    return keyed.withColumn("tile", F.explode(F.when(F.col("chunks").isNull(), one).otherwise(others))).select(
        F.xxhash64("key", "tile.lo", "tile.hi").alias("tile"), "id", *[c for c in keyed.columns if c[0] == "f" and c[1:].isdigit()], *keep
    )


def _by_tile(tiles: DataFrame, links: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `links` makes of frames of whole tiles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition holds whole tiles in order; the last tile of a batch may go on in the next.
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame["tile"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield links(frame.iloc[:cut])
            rest = frame.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest) > 1:
            yield links(rest)

    return tiles.repartition("tile").sortWithinPartitions("tile", "id").mapInPandas(run, schema)


def _groups(frame: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a frame of whole tiles, and each row's first and last row of its tile."""
    key = frame["tile"].to_numpy()
    first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    size = np.diff(np.concatenate([first, [len(key)]]))
    rows = np.stack([frame[x].to_numpy().view(np.uint64) for x in names], axis=1)
    return rows, np.repeat(first, size), np.repeat(first + size, size)


def _tile_links(tiles: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance): for each tile the links of a spanning forest of least distance."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        rows, first, last = _groups(frame, ["f0"])
        pairs = close_pairs(rows, first, last, radius)
        i, j, distance = (x[forest(len(rows), pairs)] for x in pairs)
        ids = frame["id"].to_numpy()
        return pd.DataFrame({"a": ids[i], "b": ids[j], "distance": distance.astype(np.int32)})

    return _by_tile(tiles, links, "a long, b long, distance int")


def _open_pairs(frame: pd.DataFrame, masks: list[tuple[int, int]], radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in the order of i: pairs within the radius whose sizes allow the similarity, in the first table where they meet."""
    rows, first, last = _groups(frame, ["f0", "f1"])
    table, size = (frame[x].to_numpy() for x in ("table", "size"))
    wide = np.array(masks, np.uint64)
    for pairs in close_runs(rows, first, last, radius, RUN_BLOCKS):
        i, j = pairs.i, pairs.j
        fit = (table[i] == table[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
        i, j = i[fit], j[fit]
        for k, mask in enumerate(wide):
            if not len(i) or k >= table[i].max():
                break
            met = (table[i] > k) & ~((rows[i] ^ rows[j]) & mask).any(axis=1)
            i, j = i[~met], j[~met]
        yield i, j


def _similar_links(reps: DataFrame, texts: DataFrame, masks: list[tuple[int, int]], radius: int, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links that connect whatever rows (node, id, f0, f1, text_hash, size) meet in a table within the radius and are similar.

    A first pass over the tiles finds, by bit-sliced distances alone, the rows
    that have a pair to check; only their shingle sets (of texts: id, text) go
    to these tiles, once a tile. There each pair is checked exactly, in its
    first table, unless links of the tile join its ends already: a tile of n
    rows sends on n - 1 sure links at most and no candidate leaves it.
    """

    def wanted(frame: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(frame), bool)
        for i, j in _open_pairs(frame, masks, radius, similarity):
            found[i] = found[j] = True
        return frame[found]

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        size, ids, sets = frame["size"].to_numpy(), frame["id"].to_numpy(), frame["shingles"].to_list()
        ends = np.cumsum(size)
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        seen = np.zeros(len(codes), bool)
        root = np.arange(len(frame))
        sure = []
        for left, right in _open_pairs(frame, masks, radius, similarity):
            starts = np.unique(left, return_index=True)[1]
            for i, others in zip(left[starts].tolist(), np.split(right, starts[1:])):
                j = others[root[others] != root[i]]
                if not len(j):
                    continue
                own = codes[ends[i] - size[i] : ends[i]]
                upto = np.cumsum(size[j]) - size[j]
                seen[own] = True
                held = seen[codes[np.arange(size[j].sum()) + np.repeat(ends[j] - size[j] - upto, size[j])]]
                seen[own] = False
                shared = np.add.reduceat(held, upto, dtype=np.int64)
                for k in j[shared >= similarity * (size[i] + size[j] - shared)].tolist():
                    if root[k] != root[i]:
                        root[root == root[k]] = root[i]
                        sure.append((i, k))
        i, j = np.array(sure, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": ids[i], "b": ids[j]})

    keys = F.array(*(F.struct(F.lit(k).alias("table"), x.alias("key")) for k, x in enumerate(_keys(masks))))
    keyed = reps.select(F.col("node").alias("id"), "f0", "f1", "size", F.explode(keys).alias("k")).select("id", "f0", "f1", "size", "k.table", "k.key")
    live = written(_by_tile(_tiles(keyed, ("table", "size"), "size"), wanted, "tile long, id long, f0 long, f1 long, table int, size int"))
    asked = reps.join(live.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "id", "text_hash")
    return _by_tile(live.join(_shingle_sets(asked, texts, shingle), "id"), links, "a long, b long")


def _keys(masks: list[tuple[int, int]]) -> list[Column]:
    """The bucket of a 128-bit fingerprint in each table."""
    return [F.xxhash64(F.lit(k), F.col("f0").bitwiseAND(_long(m)), F.col("f1").bitwiseAND(_long(n))) for k, (m, n) in enumerate(masks)]


def radius_links(reps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b, distance) that connect whatever rows (id, f0) lie within `radius` bits; f0 must be distinct."""
    masks = block_choices(radius + SPARE_BLOCKS, radius)
    keys = F.array(*(F.struct(F.lit(k).alias("c"), F.col("f0").bitwiseAND(_long(m)).alias("v")) for k, m in enumerate(masks)))
    keyed = reps.select("id", "f0", F.explode(keys).alias("k")).select("id", "f0", F.xxhash64("k.c", "k.v").alias("key"))
    return _tile_links(_tiles(keyed), radius)


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    Fingerprints link at `radius` differing bits or fewer (all of them are
    found); component_id is the smallest id reachable, a row's own included. Ids must be whole numbers.
    Rows with a null id have a fingerprint and a null component, and link
    nothing. Repeated rows and repeated ids each keep their own row. Texts are
    read as `fingerprints` says. Other columns of docs play no part.
    """
    marks = written(fingerprints(whole_ids(docs, id_col), id_col, text_col, shingle).select(F.col("id").cast("long").alias("id"), "f0"))
    reps = written(marks.where("id is not null").groupBy("f0").agg(F.min("id").alias("id")))
    classes = connected_components(radius_links(reps, radius), "a", "b")
    named = reps.join(classes, F.col("id") == F.col("node"), "left").select(F.col("f0").alias("g0"), F.coalesce("component", "id").alias("component_id"))
    return marks.join(named, F.col("f0") == F.col("g0"), "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def tables_for(bits: int, similarity: float, miss: float) -> int:
    """How many buckets of `bits` bits a text needs for a pair at this Jaccard similarity to miss all with chance `miss`."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(math.log(miss) / math.log(1 - agree**bits))


def reach(bits: int, similarity: float, miss: float) -> tuple[int, list[tuple[int, int]]]:
    """The radius of 128-bit fingerprints for a similarity, and each table's sampled bits."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.ceil(128 * angle + 3 * math.sqrt(128 * angle * (1 - angle)))
    draw = np.random.default_rng(64)
    masks = []
    for _ in range(tables_for(bits, similarity, miss)):
        mask = sum(1 << int(b) for b in draw.choice(128, bits, replace=False))
        masks.append((mask & (1 << 64) - 1, mask >> 64))
    return radius, masks


def bits_for(rows: int) -> int:
    """Bits of a bucket: so many that rows that have nothing in common leave about TILE in each, and 13 at least."""
    return max(13, math.ceil(math.log2(max(1, rows) / TILE)))


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bits: int | None = None, miss: float = 0.003
) -> DataFrame:
    """(id_col, text_key, component_id, first): classes of texts whose shingle sets have a Jaccard similarity of `similarity` or more.

    SimHash alone can't tell 0.8 from 0.7, so 128-bit fingerprints of the
    shingle sets only choose candidates: buckets of `bits` sampled bits (see
    `bits_for`; as many buckets as leave a pair at the threshold unmet with
    chance `miss`), then bit-sliced distances up to three standard deviations
    over what the threshold gives. Every pair that meets is checked on the
    whole shingle sets inside its tile, unless its ends are joined already.
    Texts of the same words collapse first.

    One row comes out for each row that goes in: text_key is Spark's xxhash64
    of the text as it stands, component_id the smallest id of the class, and
    `first` is true on the row that stands for it, the one with the smallest
    id and text_key (on each of its repeats). Texts that share an id have
    their own classes. Ids must be whole numbers. A null id belongs to no
    class: component_id and first are null. Other cases are as in `fingerprints`.
    """
    texts = whole_ids(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = written(fingerprints(texts, "id", "text", shingle, 2, repeats=False, raw=True))
    own = F.struct("id", "text_key")
    reps = marks.where("id is not null").groupBy("f0", "f1", "text_hash").agg(F.min(own).alias("low"), F.min("size").alias("size"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), F.col("low.id").alias("id"), "f0", "f1", "text_hash", "size", "low"))
    radius, masks = reach(bits or bits_for(reps.count()), similarity, miss)
    classes = connected_components(_similar_links(reps, texts, masks, radius, similarity, shingle), "a", "b")
    lows = classes.join(reps.select("node", "low"), "node")
    lows = lows.join(lows.groupBy("component").agg(F.min("low").alias("least")), "component").select("node", "least")
    named = reps.join(lows, "node", "left").select(
        F.col("f0").alias("g0"), F.col("f1").alias("g1"), F.col("text_hash").alias("g2"), F.coalesce("least", "low").alias("least")
    )
    same = (F.col("f0") == F.col("g0")) & (F.col("f1") == F.col("g1")) & (F.col("text_hash") == F.col("g2"))
    known = F.col("id").isNotNull()
    return marks.join(named, same, "left").select(
        F.col("id").alias(id_col), "text_key", F.when(known, F.col("least.id")).alias("component_id"), F.when(known, own == F.col("least")).alias("first")
    )


def _shingle_sets(asked: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles): the whole texts' sets of shingle hashes for `asked` (node, id, text_hash), under their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                split = split_words(part.column("text"), lower=True)
                whole, sets = [], []
                for i, x in enumerate(split.joined()):
                    whole.append(xxhash.xxh64_intdigest(x, 42))
                    sets.append(np.unique(shingle_hashes(x, split.lengths[split.offsets[i] : split.offsets[i + 1]], shingle)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_signed(whole)), pa.array(sets, pa.list_(pa.int64()))], ["id", "text_hash", "shingles"])

    found = texts.join(asked.select("id").distinct(), "id", "left_semi").mapInArrow(run, "id long, text_hash long, shingles array<long>")
    return written(found.join(asked, ["id", "text_hash"]).select(F.col("node").alias("id"), "shingles").dropDuplicates(["id"]))
