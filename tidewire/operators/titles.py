"""Bounds on how alike two titles can be, cheap ones first; no bound is ever below the ratio of matching blocks.

Matching blocks keep their order, so their letters are a common subsequence,
and each letter beyond it is unmatched. A title's letters, counted (the second
e is another thing than the first), are hashed to bits: every bit that only one
title has stands for at least one unmatched letter. Its pairs of neighbours,
counted, are hashed likewise: D unmatched letters leave at most D + 1 blocks,
and so at most 3 D pairs of neighbours that only one title has; a second title
of 200 letters and more allows far fewer blocks, as letters that are often in
it begin none, and n blocks leave D + 2 n - 2 such pairs. What passes that is
bounded, first for 64 letters at a time, by the longest common subsequence, a
few operations on whole numbers for each letter, and only what passes all is
worth the blocks themselves.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

BITS, WORD_BITS = 1024, 256
#: Left titles, and pairs, that are screened at a time.
BATCH, PAIRS = 64, 1 << 14
#: Pairs that wait for the dearer bounds at most.
CHUNK = 1 << 18
#: Words of the table of places at most; beyond, pairs are taken one by one.
PLACES = 1 << 23
#: Letters from which the matcher passes over letters that are often in the second title, and no number of letters at all.
LONG, ANY = 200, 0xFFFF


def signature(parts: list, bits_: int = BITS) -> int:
    """Bits of things, each with how often it came before."""
    seen: dict = {}
    bits = 0
    for x in parts:
        n = seen[x] = seen.get(x, 0) + 1
        # The product's highest bits depend on all of x.
        bits |= 1 << (x * 0x9E3779B97F4A7C15 + n * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF) * bits_ // (1 << 64)
    return bits


def rare_letters(text: str) -> int:
    """How many letters of a second title can begin a matching block; beyond the common start of both titles, each block holds one."""
    if len(text) < LONG:
        return ANY
    most = len(text) // 100 + 1
    return min(ANY, sum(n for n in Counter(text).values() if n <= most))


class Title:
    """A title with the bits of its letters and of their pairs, as `marks` has them; where its letters stand is found when first asked for."""

    __slots__ = ("text", "size", "bits", "pair_bits", "rare", "_places")

    def __init__(self, text: str, marks: bytes | None = None) -> None:
        self.text, self.size, self._places = text, len(text), None
        if marks is None:
            letters = [ord(x) for x in text]
            self.bits, self.pair_bits, self.rare = signature(letters), signature([x << 21 | y for x, y in zip(letters, letters[1:])]), rare_letters(text)
        else:
            n = BITS // 8
            self.bits, self.pair_bits, self.rare = (int.from_bytes(x, "little") for x in (marks[:n], marks[n : 2 * n], marks[2 * n :]))

    def marks(self) -> bytes:
        """What the bounds need, to be worked out once for a title that goes to many tasks."""
        return b"".join(x.to_bytes(n, "little") for x, n in ((self.bits, BITS // 8), (self.pair_bits, BITS // 8), (self.rare, 2)))

    def places(self) -> dict[str, int]:
        if self._places is None:
            self._places = {}
            for k, x in enumerate(self.text):
                self._places[x] = self._places.get(x, 0) | 1 << k
        return self._places


def may_reach(a: Title, b: Title, least: float) -> bool:
    """False only if the ratio of matching blocks (b is the second title) is below `least`, by lengths and bits."""
    unmatched = (1 - least) * (a.size + b.size) + 1e-9
    return abs(a.size - b.size) <= unmatched and (a.bits ^ b.bits).bit_count() <= unmatched and (a.pair_bits ^ b.pair_bits).bit_count() <= unmatched + 2 * min(unmatched, b.rare)


def ceiling(a: Title, b: Title) -> float:
    """The ratio of the longest common subsequence, which that of matching blocks can't exceed."""
    if not a.size + b.size:
        return 1.0
    places, full = b.places(), (1 << b.size) - 1
    open_ = full
    for x in a.text:
        met = open_ & places.get(x, 0)
        open_ = (open_ + met | open_ - met) & full
    return 2 * (b.size - open_.bit_count()) / (a.size + b.size)


def _codes(titles: list[Title]) -> np.ndarray:
    """(title, place): letters as numbers from 1, 0 beyond a title's end."""
    grid = np.array([t.text for t in titles] + [" "]).view(np.uint32).reshape(len(titles) + 1, -1)[:-1]
    return np.where(np.arange(grid.shape[1]) < np.array([t.size for t in titles], np.int64)[:, None], grid.astype(np.int64) + 1, 0)


def _places(left: list[Title], right: list[Title]) -> tuple[np.ndarray, np.ndarray] | None:
    """Letters of the left titles as numbers (0: none of the right ones' letters), and where in the right ones each stands, 64 places a word; None if that is too large."""
    ours, theirs = _codes(left), _codes(right)
    letters = np.unique(theirs)
    letters = letters[letters > 0]
    words = max(1, -(-theirs.shape[1] // 64))
    if words * len(right) * (len(letters) + 1) > PLACES or ours.shape[1] > 64 * 64:
        return None
    at = np.searchsorted(letters, theirs) + 1
    places = np.zeros((words, len(letters) + 1, len(right)), np.uint64)
    every = np.arange(len(right))
    for k in range(theirs.shape[1]):
        on = theirs[:, k] > 0
        places[k >> 6, at[on, k], every[on]] |= np.uint64(1) << np.uint64(k & 63)
    found = np.minimum(np.searchsorted(letters, ours), max(0, len(letters) - 1))
    return np.where(letters[found] == ours, found + 1, 0).astype(np.int64) if len(letters) else np.zeros(ours.shape, np.int64), places


def ceilings(left: list[Title], right: list[Title], pairs: list[tuple[int, int]]) -> np.ndarray:
    """`ceiling` of many pairs: one letter of all left titles at a time, with carries between the words of the right ones."""
    table = _places(left, right) if pairs else None
    if table is None:
        return np.array([ceiling(left[i], right[j]) for i, j in pairs])
    codes, places = table
    sizes = np.array([t.size for t in left]), np.array([t.size for t in right])
    told = np.array(pairs)
    out = np.empty(len(told))
    for a in range(0, len(told), PAIRS):
        i, j = told[a : a + PAIRS].T
        open_ = [np.full(len(i), ~np.uint64(0)) for _ in range(len(places))]
        for k in range(int(sizes[0][i].max())):
            code, carry = codes[i, k], np.zeros(len(i), np.uint64)
            for w in range(len(places)):
                was, met = open_[w], open_[w] & places[w, code, j]
                total = was + met
                full = total + carry
                carry = ((total < was) | (full < total)).astype(np.uint64)
                open_[w] = full | (was ^ met)
        # Bits beyond a title's end stay open.
        common = sum(64 - np.bitwise_count(x).astype(np.int64) for x in open_)
        both = sizes[0][i] + sizes[1][j]
        out[a : a + PAIRS] = np.where(both > 0, 2 * common / np.maximum(both, 1), 1.0)
    return out


def near_enough(left: list[Title], right: list[Title], pairs: Iterable[tuple[int, int]], least: float) -> Iterator[tuple[int, int]]:
    """The pairs of which `ceiling` is `least` or more, by ever dearer bounds, some at a time.

    Of 64 letters of the right title at least those are unmatched that are
    beyond their longest common subsequence with the stretch of the left one
    that few enough unmatched letters can bring against them. What these
    stretches leave gets the common subsequence of the whole titles.
    """
    pairs = iter(pairs)
    told = list(islice(pairs, CHUNK))
    table = _places(left, right) if told else None
    size, sizes = (np.array([t.size for t in ts], np.int64) for ts in (left, right))
    while told:
        if table is not None:
            told = _by_stretches(*table, size, sizes, np.array(told), least)
        ours, theirs = sorted({i for i, _ in told}), sorted({j for _, j in told})
        i_of, j_of = {x: n for n, x in enumerate(ours)}, {x: n for n, x in enumerate(theirs)}
        most = ceilings([left[i] for i in ours], [right[j] for j in theirs], [(i_of[i], j_of[j]) for i, j in told])
        yield from (p for p, c in zip(told, most) if c >= least - 1e-12)
        told = list(islice(pairs, CHUNK))


def _by_stretches(codes: np.ndarray, places: np.ndarray, size: np.ndarray, sizes: np.ndarray, told: np.ndarray, least: float) -> list[tuple[int, int]]:
    flat, kept = places.reshape(len(places), -1), []
    for a in range(0, len(told), PAIRS):
        part = told[a : a + PAIRS]
        lost = np.zeros(len(part), np.int64)
        for w in range(len(places)):
            i, j = part.T
            matched = least * (size[i] + sizes[j]) / 2 - 1e-9
            ours, theirs = np.floor(size[i] - matched).astype(np.int64), np.floor(sizes[j] - matched).astype(np.int64)
            start, end = 64 * w - theirs, np.minimum(64 * w + 64 + ours, size[i])
            open_ = np.full(len(part), ~np.uint64(0))
            for k in range(int((end - start).max(initial=0))):
                at = start + k
                code = np.where((at >= 0) & (at < end), codes[i, np.clip(at, 0, codes.shape[1] - 1)], 0)
                met = open_ & flat[w].take(code * len(sizes) + j)
                open_ = (open_ + met) | (open_ ^ met)
            lost += np.clip(sizes[j] - 64 * w, 0, 64) - (64 - np.bitwise_count(open_).astype(np.int64))
            part, lost = part[lost <= theirs], lost[lost <= theirs]
        kept += part.tolist()
    return [(i, j) for i, j in kept]


def _table(numbers: list[int], bits: int = BITS) -> np.ndarray:
    """(number, word) of large numbers."""
    return np.frombuffer(b"".join(n.to_bytes(bits // 8, "little") for n in numbers), np.uint64).reshape(len(numbers), bits // 64)


def _differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right): in how many bits the numbers of two tables (word, number) differ."""
    shape = left.shape[1], right.shape[1]
    out, both, count = np.zeros(shape, np.uint16), np.empty(shape, np.uint64), np.empty(shape, np.uint8)
    for mine, other in zip(left, right):
        np.bitwise_xor(mine[:, None], other, out=both)
        np.bitwise_count(both, out=count)
        np.add(out, count, out=out)
    return out


def differing(left: list[int], right: list[int], bits: int = BITS) -> np.ndarray:
    """(left, right): in how many bits two numbers differ."""
    return _differing(_table(left, bits).T.copy(), _table(right, bits).T.copy())


def pairs_within(left: list[Title], right: list[Title], least: float, either: bool = False) -> Iterator[tuple[int, int]]:
    """The pairs of which `may_reach` holds (or with the left title as the second one, if `either`), many at a time.

    Both sides go in the order of their sizes, so only right titles of a fit
    length are looked at, first by their pairs of neighbours.
    """
    mine, other = (np.array(sorted(range(len(ts)), key=lambda n: ts[n].size), np.int64) for ts in (left, right))
    numbers = lambda ts, name: np.array([getattr(t, name) for t in ts], np.int64)
    size, sizes, rare, rares = numbers(left, "size"), numbers(right, "size")[other], numbers(left, "rare"), numbers(right, "rare")[other]
    bits, theirs = _table([t.bits for t in left]), _table([t.bits for t in right])
    pair_bits, their_pairs = _table([t.pair_bits for t in left]), _table([right[j].pair_bits for j in other]).T.copy()
    for a in range(0, len(mine), BATCH):
        part = mine[a : a + BATCH]
        own, slack = size[part][:, None], 2 * (1 - least) + 1e-6
        fit = slice(*np.searchsorted(sizes, [own[0, 0] * least / (2 - least) - slack, own[-1, 0] * (2 - least) / least + slack] if least > 0 else [0, 1 << 40]))
        unmatched = (1 - least) * (own + sizes[fit]) + 1e-9
        blocks = np.maximum(rare[part][:, None], rares[fit]) if either else rares[fit]
        good = _differing(pair_bits[part].T.copy(), np.ascontiguousarray(their_pairs[:, fit])) <= unmatched + 2 * np.minimum(unmatched, blocks)
        good &= np.abs(own - sizes[fit]) <= unmatched
        i, j = np.nonzero(good)
        unmatched, i, j = unmatched[i, j], part[i], other[fit][j]
        on = np.bitwise_count(bits[i] ^ theirs[j]).sum(1, dtype=np.int64) <= unmatched
        yield from zip(i[on].tolist(), j[on].tolist())


def word_bits(words: Iterable[str]) -> int:
    """Bits of a set of words."""
    return signature([zlib.crc32(w.encode()) for w in words], WORD_BITS)


def sets_within(left: list[set], right: list[set], least: float, bits: tuple[list[int], list[int]] | None = None) -> Iterator[tuple[int, int]]:
    """The pairs of sets of words (whose `word_bits` may be known) whose Jaccard is `least` or more."""
    mine, theirs = (_table(x, WORD_BITS).T.copy() for x in bits or ([word_bits(x) for x in left], [word_bits(x) for x in right]))
    size, sizes = (np.array([len(s) for s in sets], np.int64) for sets in (left, right))
    for a in range(0, len(left), BATCH):
        both = size[a : a + BATCH, None] + sizes
        for i, j in zip(*np.nonzero(_differing(np.ascontiguousarray(mine[:, a : a + BATCH]), theirs) <= (1 - least) / (1 + least) * both + 1e-9)):
            x, y = left[i + a], right[j]
            if x and len(x & y) >= least * len(x | y) - 1e-9:
                yield int(i) + a, int(j)
