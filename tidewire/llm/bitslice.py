"""Bit-sliced Hamming distances between the fingerprints of one tile."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes added between two looks at which blocks are still within the radius.
STEP = 8


class Pairs(NamedTuple):
    """Rows i < j of a tile, and the number of bits in which they differ."""

    i: np.ndarray
    j: np.ndarray
    distance: np.ndarray


def planes_of(rows: np.ndarray) -> np.ndarray:
    """Fingerprints (n, w) of 64-bit words as planes (64 w, n / 64): bit b of row r is bit r of plane b."""
    n = len(rows)
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in every lane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose vertical counter exceeds the radius."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            more |= same & counters[k]
            same = same & ~counters[k]
    return more


def close_pairs(rows: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int, blocks: int = 1 << 18) -> Pairs:
    """All pairs at `radius` bits or less within the groups of a tile.

    rows: (n, w) fingerprints, the groups being runs of rows; row i is compared
    with the rows after it up to last[i] (exclusive), first[i] being the start
    of its group. A block is one row against 64 others, one lane for each.
    Carry-save adders feed eight planes at a time into vertical counters; a
    block whose lanes have all passed the radius is dropped with no further
    plane read. `blocks` bounds what is compared at a time.
    """
    out = list(close_runs(rows, first, last, radius, blocks))
    return Pairs(*(np.concatenate(x) for x in zip(*out))) if out else Pairs(*(np.empty(0, np.int64),) * 3)


def close_runs(rows: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int, blocks: int) -> Iterator[Pairs]:
    """The pairs of `close_pairs` in the order of i, `blocks` blocks at a time; one i's pairs come together."""
    n, planes = len(rows), planes_of(rows)
    start, end = np.arange(n) // 64, (last - 1) // 64
    per_row = end - start + 1
    cuts = np.flatnonzero(np.diff((np.cumsum(per_row) - 1) // blocks)) + 1
    for a, b in zip([0, *cuts], [*cuts, n]):
        query = np.repeat(np.arange(a, b), per_row[a:b])
        word = np.arange(len(query)) - np.repeat(np.cumsum(per_row[a:b]) - per_row[a:b], per_row[a:b]) + start[query]
        yield _survivors(planes, query, word, last, radius)


def _lanes(query: np.ndarray, word: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The lanes of each block that stand for rows after the query and within its group."""
    low = np.clip(query + 1 - 64 * word, 0, 64).astype(np.uint64)
    high = np.clip(last[query] - 64 * word, 0, 64).astype(np.uint64)
    ones = lambda k: np.where(k >= 64, FULL, (np.uint64(1) << np.minimum(k, np.uint64(63))) - np.uint64(1))
    return ones(high) & ~ones(low)


def _survivors(planes: np.ndarray, query: np.ndarray, word: np.ndarray, last: np.ndarray, radius: int) -> Pairs:
    open_lanes = _lanes(query, word, last)
    counters = [np.zeros(len(query), np.uint64) for _ in range((radius + STEP).bit_length())]

    def keep(live: np.ndarray) -> None:
        nonlocal query, word, open_lanes, counters
        query, word, open_lanes = query[live], word[live], open_lanes[live]
        counters = [c[live] for c in counters]

    keep(open_lanes != 0)
    for at in range(0, len(planes), STEP):
        if not len(query):
            break
        own = (query >> 6, (query & 63).astype(np.uint64))
        x = [planes[p, word] ^ (np.uint64(0) - ((planes[p, own[0]] >> own[1]) & np.uint64(1))) for p in range(at, at + STEP)]
        c0, c1, c2 = counters[:3]
        fours = []
        for q in (0, 4):
            c0, a = _full_add(c0, x[q], x[q + 1])
            c0, b = _full_add(c0, x[q + 2], x[q + 3])
            c1, f = _full_add(c1, a, b)
            fours.append(f)
        c2, carry = _full_add(c2, *fours)
        counters[:3] = c0, c1, c2
        for k in range(3, len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        open_lanes &= ~_beyond(counters, radius)
        live = open_lanes != 0
        if not live.all():
            keep(live)
    lanes = np.unpackbits(open_lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, lane = np.nonzero(lanes)
    distance = np.zeros(len(block), np.int64)
    for k, c in enumerate(counters):
        distance |= ((c[block] >> lane.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k
    return Pairs(query[block], word[block] * 64 + lane, distance)


def forest(n: int, pairs: Pairs) -> np.ndarray:
    """Indexes of the pairs of a spanning forest of least distance over n rows (Kruskal)."""
    parent = list(range(n))
    kept = []
    order = np.argsort(pairs.distance, kind="stable")
    for k, i, j in zip(order.tolist(), pairs.i[order].tolist(), pairs.j[order].tolist()):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[j] = i
            kept.append(k)
    return np.array(kept, np.int64)
