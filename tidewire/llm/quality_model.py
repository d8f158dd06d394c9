"""A quality score from compression: which of two dictionaries shortens a text more.

One zstandard dictionary is trained on good and one on bad labelled text. A
text is cut into pieces of `PIECE` bytes, each compressed with either, so that
the dictionaries and not the text's own past decide; the difference of the
summed sizes, divided by the text's bytes, becomes a probability by a logistic
curve fitted on labelled texts that no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import byte_slices

#: Labelled texts of each class that are learned from at most, half for the dictionary and half for the curve, and their bytes (see `learn`).
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 12 << 20
PIECE, DICTIONARY_BYTES, LEVEL = 256, 110 << 10, 3


def remainder(id_col: str, parts: int = 4) -> Column:
    """crc32 of the id as text modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def pieces_of(text: bytes) -> list[bytes]:
    return [text[k : k + PIECE] for k in range(0, len(text), PIECE)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts themselves where there is too little to train on."""
    parts = [p for t in texts for p in pieces_of(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, with a weak pull to zero (Newton's method)."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


@dataclass
class QualityModel:
    """good, bad: dictionaries. slope, offset: of the logistic curve."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def differences(self) -> "_Differences":
        return _Differences(self.good, self.bad)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences + self.offset, -35, 35)))


class _Differences:
    """Bytes that the good dictionary saves over the bad one, for each byte of a text."""

    def __init__(self, *dictionaries: bytes) -> None:
        self.packers = []
        for d in dictionaries:
            shared = zstandard.ZstdCompressionDict(d) if d else None
            if shared:
                shared.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(self, text: bytes) -> float:
        good, bad = (sum(len(pack(p)) for p in pieces_of(text)) for pack in (x.compress for x in self.packers))
        return (bad - good) / max(1, len(text))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", hold_out: int = 2, rows: int = SAMPLE_ROWS, bytes_: int = SAMPLE_BYTES
) -> QualityModel:
    """Fits the model on labelled rows whose id's remainder isn't `hold_out`.

    What is learned from is a bounded sample, so that it fits the driver at any
    size: of each class `rows` ids at most, those with the least id hash, one
    whole text of each (of several the one with the least hash), and of these,
    in the order of another hash, as many as make `bytes_` bytes; texts of over an eighth of that teach nothing, so one long
    text can't displace the others. Null ids, labels or texts teach nothing. With no label of one class
    the score is the same for all texts: the share of good labels, smoothed.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where((remainder("id") != hold_out) & F.col("label").isin(0, 1))
    texts: dict[int, list[tuple[int, bytes]]] = {}
    for label in (0, 1):
        chosen = known.where(F.col("label") == label).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
        found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
        found = found.withColumns({"size": F.octet_length("text"), "key": F.xxhash64("text"), "draw": F.xxhash64(F.lit(7), "id")}).where(F.col("size") <= bytes_ // 8)
        # Sizes alone decide who is chosen: of an id one text counts, so no more than `rows` small rows are put in order.
        one = found.groupBy("id", "draw").agg(F.min(F.struct("key", "size")).alias("m")).select("id", "draw", "m.key", "m.size")
        kept = one.withColumn("upto", F.sum("size").over(_in_order())).where(F.col("upto") <= bytes_).select("id", "key")
        told = found.join(F.broadcast(kept), ["id", "key"]).groupBy("draw", "id").agg(F.min("text").alias("text"))
        texts[label] = [(r.draw & 1, r.text.encode()) for r in told.orderBy("draw", "id").collect()]
    good, bad = (_dictionary([t for half, t in texts[label] if half]) for label in (1, 0))
    if not good or not bad:
        n, g = sum(map(len, texts.values())), len(texts[1])
        share = (g + 1) / (n + 2)
        return QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    by = _Differences(good, bad)
    rest = [(by.of(t), label) for label in (0, 1) for half, t in texts[label] if not half]
    x, y = np.array([r[0] for r in rest]), np.array([float(r[1]) for r in rest])
    slope, offset = _logistic(x, y)
    return QualityModel(good, bad, slope, offset)


def _in_order():
    """Over the bounded sample only."""
    from pyspark.sql import Window

    return Window.orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def scored(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, hold_out: int = 2) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row, from its whole text alone.

    A null or empty text has difference zero and so the curve's value there.
    Null ids are not held out. Repeated rows and other columns change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = model.differences()
        for batch in batches:
            for part in byte_slices(batch):
                x = np.array([by.of(t.encode()) if t else 0.0 for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(x), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(remainder("id") == hold_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
