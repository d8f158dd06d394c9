"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With weight w, its block k may go out from
slot floor(k / w) and must by slot ceil((k + 1) / w); of the blocks that may,
the one with the earliest deadline takes the next slot. Times are whole-number
arithmetic on the weights as given, so each source stays within one block of its
share at every slot of tables of any size.

Where a source stands at a slot is one of two numbers of blocks, so a state is a
bit a source, and slots are cut into ranges that go to tasks by themselves. A
range guesses its state: it begins one range early, at a state that holds what
is due and of the rest the earliest deadlines. Schedules from different states
soon agree, as the earliest deadline goes first in both. Each range tells the
state it began with and the one it ends with; ranges that began with another
one than the range before ends with run again on that, until none do. What
comes out is the schedule of one pass over all blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Blocks that a range releases, about, and most of a plan that is made at once and broadcast.
RANGE, SMALL_PLAN = 100_000, 50_000
PLAN = "_mix_s string, _mix_turn long, mix_release long, mix_deadline long, mix_slot long"
#: Documents of a block, and about how many a ranking bucket holds.
BLOCK, BUCKET = 64, 2_000


class Pace:
    """Sources with their weights in whole parts and their numbers of blocks."""

    def __init__(self, weights: dict[str | None, float], blocks: dict[str | None, int]) -> None:
        if weights and not (min(weights.values()) > 0 and max(weights.values()) < math.inf):
            raise ValueError("weights must be positive")
        self.names = sorted(blocks, key=lambda s: (s is None, s or ""))
        exact = [Fraction(weights[s]) for s in self.names]
        common = math.lcm(*(w.denominator for w in exact))
        self.parts = [int(w * common) for w in exact]
        self.total, self.blocks = sum(self.parts), [blocks[s] for s in self.names]

    def due(self, slot: int) -> list[int]:
        """Of each source the blocks whose deadline has come by a slot."""
        return [min(b, slot * p // self.total) for p, b in zip(self.parts, self.blocks)]

    def guess(self, slot: int) -> list[int]:
        """Of each source 1 if a block that may but needn't be out by a slot is taken to be."""
        begun = [min(b, -(-slot * p // self.total)) for p, b in zip(self.parts, self.blocks)]
        due = self.due(slot)
        may = sorted((-(-(d + 1) * self.total // self.parts[n]), n) for n, (d, r) in enumerate(zip(due, begun)) if r > d)
        taken = {n for _, n in may[: max(0, slot - sum(due))]}
        return [int(n in taken) for n in range(len(due))]

    def run(self, done: list[int], slot: int, end: int | None = None) -> Iterator[tuple[str | None, int, int, int, int]]:
        """(source, block, release, deadline, slot) from a slot before `end`, by earliest deadline among released blocks; counts on in `done`."""
        release = lambda n, k: k * self.total // self.parts[n]
        coming = [(release(n, k), n, k) for n, k in enumerate(done) if k < self.blocks[n]]
        heapq.heapify(coming)
        waiting: list[tuple[int, int, int]] = []
        while coming or waiting:
            if not waiting:
                slot = max(slot, coming[0][0])
            if end is not None and slot >= end:
                return
            while coming and coming[0][0] <= slot:
                _, n, k = heapq.heappop(coming)
                heapq.heappush(waiting, (-(-(k + 1) * self.total // self.parts[n]), n, k))
            deadline, n, k = heapq.heappop(waiting)
            yield self.names[n], k, release(n, k), deadline, slot
            done[n] = k + 1
            if k + 1 < self.blocks[n]:
                heapq.heappush(coming, (release(n, k + 1), n, k + 1))
            slot += 1

    def bits(self, done: list[int], slot: int) -> bytes:
        """The state at a slot; empty if it is none, as may follow from a wrong guess."""
        over = [a - b for a, b in zip(done, self.due(slot))]
        return np.packbits(over).tobytes() if set(over) <= {0, 1} else b""

    def counts(self, bits: bytes, slot: int) -> list[int]:
        return [d + b for d, b in zip(self.due(slot), np.unpackbits(np.frombuffer(bits, np.uint8), count=len(self.parts)).tolist())]

    def cuts(self, size: int) -> list[int]:
        """Slots from 0 between which about `size` blocks are released."""
        share, blocks = np.array([p / self.total for p in self.parts]), np.array(self.blocks, float)
        out, low = [0], 0.0
        last = float((blocks / share).max())
        for k in range(1, -(-sum(self.blocks) // size)):
            high = last
            while high - low > max(1.0, low * 1e-9):
                mid = (low + high) / 2
                low, high = (mid, high) if np.minimum(blocks, mid * share).sum() < k * size else (low, mid)
            if int(high) > out[-1]:
                out.append(int(high))
        return out


def exact_schedule(weights: dict[str | None, float], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block in the order of slots, by earliest deadline among released blocks."""
    pace = Pace(weights, blocks)
    for row in pace.run([0] * len(pace.names), 0):
        if row[3] <= row[4]:
            raise AssertionError("a deadline was missed")
        yield row


def ranged_schedule(spark: SparkSession, weights: dict[str | None, float], blocks: dict[str | None, int], size: int | None = None) -> DataFrame:
    """`exact_schedule` as a table (PLAN), made in ranges of about `size` blocks (RANGE, or four times the sources, so that states are the smaller part)."""
    pace = Pace(weights, blocks)
    cuts = pace.cuts(size or max(RANGE, 4 * len(pace.names)))
    ends = [*cuts[1:], None]
    columns = ["range", "began", "left", *(c.split()[0] for c in PLAN.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, bits in zip(frame["range"].tolist(), frame["bits"]):
                if bits is not None:
                    done = pace.counts(bits, cuts[n])
                elif n == 0:
                    done = [0] * len(pace.names)
                else:
                    done = [d + g for d, g in zip(pace.due(cuts[n - 1]), pace.guess(cuts[n - 1]))]
                    for _ in pace.run(done, cuts[n - 1], cuts[n]):
                        pass
                began = pace.bits(done, cuts[n])
                rows = [(n, None, None, *row) for row in pace.run(done, cuts[n], ends[n])] if began or n == 0 else []
                left = pace.bits(done, ends[n]) if ends[n] is not None else b""
                yield pd.DataFrame([(n, began, left, None, None, None, None, None), *rows], columns=columns).astype({c: "Int64" for c in columns[4:]})

    def made(ranges: DataFrame) -> DataFrame:
        return written(ranges.mapInPandas(run, f"range long, began binary, left binary, {PLAN}"))

    state = F.col("began").isNotNull()
    plan = made(spark.range(0, len(cuts), 1, len(cuts)).select(F.col("id").alias("range"), F.lit(None).cast("binary").alias("bits")))
    while True:
        ahead = plan.where(state).select((F.col("range") + 1).alias("range"), F.col("left").alias("bits"))
        wrong = written(plan.where(state).select("range", "began").join(ahead, "range").where("began <> bits").select("range", "bits").repartition("range"))
        if not wrong.limit(1).count():
            return plan.where(~state).select(*columns[3:])
        # A state that a wrong guess has left is none to begin with: such a range waits for the one before it.
        again = made(wrong.where(F.length("bits") > 0))
        plan = written(plan.join(again.where(state).select("range"), "range", "left_anti").unionByName(again))


def _plan(spark: SparkSession, weights: dict[str | None, float], blocks: dict[str | None, int]) -> DataFrame:
    if sum(blocks.values()) <= SMALL_PLAN:
        return F.broadcast(spark.createDataFrame(list(exact_schedule(weights, blocks)), PLAN))
    return ranged_schedule(spark, weights, blocks)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """All rows and columns of docs with mix_block, mix_release, mix_deadline, mix_slot and mix_place.

    Ordered by (mix_slot, mix_place), every stretch of slots holds each source
    in its weight, within one block, until that source ends; later slots of a
    source that has ended are gaps and the others go on at their pace. No row
    is dropped or repeated. Within a source documents come by the hash of
    their id. A null source is a source of its own. Sources without a weight
    get the least weight given; without weights each has the root of its size.
    Null ids and repeated rows are mixed like any other. Columns of docs with
    these names are replaced; names that begin with `_mix_` are its own
    (ValueError). The driver holds one row a source.
    """
    spark = docs.sparkSession
    if clash := [c for c in docs.columns if c.startswith("_mix_")]:
        raise ValueError(f"columns of these names are taken: {clash}")
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    sizes = {r.source: r.n for r in counts.collect()}
    if weights is None:
        weights = {s: float(n) ** 0.5 for s, n in sizes.items()}
    given = {s: weights.get(s, min(weights.values(), default=1.0)) for s in sizes}
    # A source is ranked in as many buckets as it needs, whose sizes give their offsets: no task holds more of a hot one.
    table = spark.createDataFrame([(s, -(-n // BUCKET)) for s, n in sizes.items()], "_mix_t string, _mix_buckets int")
    table = F.broadcast(table) if len(sizes) <= SMALL_PLAN else table
    named = docs.drop("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")
    draw = F.xxhash64(F.lit(3), F.col(id_col))
    dealt = named.withColumn("_mix_source", F.col(source_col).cast("string")).withColumn("_mix_draw", draw).join(table, F.col("_mix_source").eqNullSafe(F.col("_mix_t")))
    dealt = dealt.withColumn("_mix_bucket", F.pmod("_mix_draw", "_mix_buckets").cast("int")).drop("_mix_t", "_mix_buckets")
    count = dealt.groupBy(F.col("_mix_source").alias("_mix_s"), F.col("_mix_bucket").alias("_mix_b")).agg(F.count("*").alias("_mix_n"))
    before = count.withColumn("_mix_before", F.sum("_mix_n").over(Window.partitionBy("_mix_s").orderBy("_mix_b")) - F.col("_mix_n")).drop("_mix_n")
    within = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_draw", id_col)
    same = F.col("_mix_source").eqNullSafe(F.col("_mix_s"))
    ranked = dealt.withColumn("_mix_rank", F.row_number().over(within) - 1).join(before, same & (F.col("_mix_bucket") == F.col("_mix_b")))
    ranked = ranked.withColumn("_mix_rank", F.col("_mix_rank") + F.col("_mix_before")).drop("_mix_s", "_mix_b")
    ranked = ranked.withColumn("mix_block", F.floor(F.col("_mix_rank") / block))
    columns = [*named.columns, "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"]
    ranked = ranked.withColumn("mix_place", (F.col("_mix_rank") % block).cast("int"))
    plan = _plan(spark, given, {s: -(-n // block) for s, n in sizes.items()})
    return ranked.join(plan, same & (F.col("mix_block") == F.col("_mix_turn"))).select(columns)
