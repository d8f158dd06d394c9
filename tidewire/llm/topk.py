"""Exact top-k search by inner product with multi-resolution segment statistics.

For a segment of n components with means m and deviations s of a query and a
candidate, the squared distance is at least n ((m - m')^2 + (s - s')^2), and so
the inner product at most n (m m' + s s'). A candidate is dropped at the
coarsest resolution whose summed bound stays under the query's k-th best exact
score so far; only survivors of the finest one count with an exact score.

A tile turns its vectors by the principal axes of its candidates, which leaves
inner products as they are, and cuts segments of equal energy: a few leading
components then make up most segments, and bounds are tight where vectors lie
near a subspace. What each level drops is measured on a tile's first block; a
level that costs more than it spares is left out of the others, so vectors with
no such subspace cost one product and no useless bounds. Where over `DENSE` of a block's pairs
survive, one matrix product costs less than picking them, and the survivors are
read from it.

Candidates are dealt into tiles; every query goes to every tile once, in
blocks, and each tile gives k rows a query. Nothing is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a tile at most (on average), and cells of a bound matrix.
TILE, CELLS = 1 << 16, 1 << 21
LEAST_TILES = 12
#: Segments at each resolution.
LEVELS = (1, 4, 16, 32)
#: Share of surviving pairs from which a block is multiplied whole.
DENSE = 0.02


def segment_statistics(vectors: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(rows, 2 segments): for each segment that ends at a cut its mean and deviation, times the root of its length."""
    out = []
    for part in np.split(vectors, cuts[:-1], axis=1):
        root = np.sqrt(part.shape[1])
        out += [root * part.mean(axis=1), root * part.std(axis=1)]
    return np.stack(out, axis=1)


def equal_energy(energy: np.ndarray, segments: int) -> np.ndarray:
    """Where segments end that hold about equal shares of the components' energy, each at least one component."""
    part = np.cumsum(energy) / max(energy.sum(), 1e-300)
    ends = np.searchsorted(part, np.arange(1, segments) / segments - 1e-9) + 1
    return np.unique(np.append(np.minimum(ends, len(energy)), len(energy)))


class Tile:
    """Candidates of one dimension with their statistics at every level.

    shares: what each level leaves of a block's pairs, by the first block; used: the levels that pay.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        real = self.vectors.astype(float)
        energy, axes = np.linalg.eigh(real.T @ real)
        self.axes, energy = axes[:, ::-1], np.maximum(energy[::-1], 0)
        self.cuts = [equal_energy(energy, min(s, len(energy))) for s in LEVELS]
        turned = real @ self.axes
        self.levels = [segment_statistics(turned, c) for c in self.cuts]
        self.shares: list[float] = []
        self.used = list(range(1, len(LEVELS)))

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate row, score) of each query's k best candidates, ties to the smaller id."""
        found = []
        step = max(1, CELLS // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            found.append(self._block(np.arange(a, min(a + step, len(ids))), ids, vectors, k))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _limits(self, bound: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
        """What a score must reach: each query's k-th best exact score among those that look best."""
        first = min(4 * k, len(self.ids))
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        guess = np.zeros(bound.shape, bool)
        np.put_along_axis(guess, best, True, axis=1)
        seen = products(vectors, self.vectors, guess).reshape(len(vectors), first).astype(float)
        seen[np.isneginf(bound[guess]).reshape(len(vectors), first)] = -np.inf
        limit = np.sort(seen, axis=1)[:, -k] if first >= k else np.full(len(vectors), -np.inf)
        return limit - 1e-6 - 1e-9 * np.abs(np.where(np.isfinite(limit), limit, 0))

    def _block(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turned = vectors[rows].astype(float) @ self.axes
        # Rounding of the turned vectors stays far below this.
        slack = 1e-9 * np.sqrt((turned**2).sum(axis=1) * max(1.0, (self.levels[0] ** 2).sum(axis=1).max(initial=0)))
        bound = segment_statistics(turned, self.cuts[0]) @ self.levels[0].T + slack[:, None]
        bound[ids[rows][:, None] == self.ids[None]] = -np.inf
        limit = self._limits(bound, vectors[rows], k)
        live = (bound >= limit[:, None]) & ~np.isneginf(bound)
        shares = [live.mean()]
        for n in self.used:
            least = np.repeat(limit - slack, live.sum(axis=1))
            live[live] = products(segment_statistics(turned, self.cuts[n]), self.levels[n], live) >= least
            shares.append(live.mean())
        if not self.shares:
            self.shares = [float(x) for x in shares]
            cost = [2 * len(self.cuts[n]) / vectors.shape[1] for n in self.used]
            self.used = [n for n, c, before, after in zip(self.used, cost, shares, shares[1:]) if before - after > c * before]
        q, x = np.nonzero(live)
        score = products(vectors[rows], self.vectors, live)
        good = score >= np.repeat(limit, live.sum(axis=1))
        q, x, score = q[good], x[good], score[good]
        order = np.lexsort((x, -score, q))
        q, x, score = q[order], x[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return rows[q[top]], x[top], score[top]


def products(left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Inner products of the wanted (row of left, row of right) pairs, row by row.

    Whole numbers stay exact: they are multiplied as doubles only if no sum can reach 2**53.
    """
    whole = left.dtype.kind == "i"
    if wanted.mean() > DENSE if wanted.size else False:
        if not whole:
            return (left @ right.T)[wanted]
        most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
        both = left.astype(float) @ right.astype(float).T if most < 1 << 53 else left @ right.T
        return both[wanted].astype(np.int64)
    q, x = np.nonzero(wanted)
    out = np.empty(len(q), np.int64 if whole else float)
    for a in range(0, len(q), 1 << 16):
        cut = slice(a, a + (1 << 16))
        out[cut] = (left[q[cut]] * right[x[cut]]).sum(axis=1)
    return out


def whole_numbers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that is null, empty or has a null or non-finite component."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(finite & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row that satisfies `queries` with all others.

    Vectors count as floor(256 x). Those that are null, empty or hold a null,
    NaN or infinite component take no part, nor do null ids. Ties go to the
    smaller id; a query's own id is no candidate; a query with fewer candidates
    gets all. Only vectors of one length are compared. Repeated query rows
    count once, repeated candidate rows each. Scores must fit 63 bits.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(vector_col).alias("v"), queries.alias("is_query")).where("v is not null and id is not null")
    tiles = max(LEAST_TILES, -(-vectors.count() // TILE))
    candidates = rows.select("id", "v", F.lit(False).alias("asks"), F.size("v").alias("size"), F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).cast("int").alias("tile"))
    asking = rows.where("is_query").select("id", "v").dropDuplicates(["id", "v"])
    asking = asking.select("id", "v", F.lit(True).alias("asks"), F.size("v").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Of each tile the candidates come first, then the queries.
        key, held, tile = None, [], None
        for frame in frames:
            runs = (frame["size"] * (tiles + 1.0) + frame["tile"]).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1), len(frame)]
            for a, b in zip(cuts, cuts[1:]):
                if runs[a] != key:
                    key, held, tile = runs[a], [], None
                part = frame.iloc[a:b]
                asks = part["asks"].to_numpy()
                if not asks.all():
                    held.append(part[~asks])
                if not asks.any() or not held:
                    continue
                if tile is None:
                    all_ = pd.concat(held)
                    tile = Tile(all_["id"].to_numpy(), np.stack(all_["v"].to_numpy()))
                ids, own = part["id"].to_numpy()[asks], np.stack(part["v"].to_numpy()[asks])
                q, x, score = tile.search(ids, own, k)
                marks = part["mark"].to_numpy()[asks]
                yield pd.DataFrame({"query_id": ids[q], "mark": marks[q], "vec_id": tile.ids[x], "score": score})

    both = candidates.withColumn("mark", F.lit(0).cast("long")).union(asking.withColumn("mark", F.xxhash64("v")))
    # Tile k is partition k: hashing tile numbers would put several into one task.
    dealt = both.repartitionById(tiles, "tile").sortWithinPartitions("size", "tile", "asks", "id")
    found = dealt.mapInPandas(run, "query_id long, mark long, vec_id long, score long")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
