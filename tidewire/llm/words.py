"""Arrow helpers for whole texts inside tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, so
no-break spaces and other Unicode blanks are parts of words. A null text has
no words. Nothing here looks at more than one slice of a batch at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a slice of a batch holds, unless one text alone is longer.
SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Returns freed memory to the system, so that workers that wait between stages hold little (where the C library can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def byte_slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about `limit` bytes of text, so that memory follows bytes and not rows."""
    give_back()
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - 1) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(start), int(end - start))
    give_back()


@dataclass
class Words:
    """The words of a run of texts: text i has words[offsets[i]:offsets[i + 1]]."""

    offsets: np.ndarray
    words: pa.Array
    lengths: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """For each word the number of its spelling, and the spellings."""
        coded = self.words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()).to_pylist()

    def joined(self) -> list[bytes]:
        """Each text's words with one space between them."""
        lists = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), self.words)
        return pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Splits texts (null: empty) into words; `lower` maps A-Z to a-z and nothing else."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    real = lengths > 0
    before = np.concatenate([[0], np.cumsum(real)])
    if not real.all():
        flat, lengths = flat.filter(pa.array(real)), lengths[real]
    return Words(before[bounds], flat, lengths)
