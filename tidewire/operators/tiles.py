"""Rows of two tables compared block by block, in tiles that spread a large block over many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task holds, and rows that go past them at most (both on average); tiles of a block from which on a task holds up to eight times as many instead.
TILE, STREAM, TILES = 1024, 1 << 16, 8


def tiled(left: DataFrame, right: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, tile: int = TILE, stream: int = STREAM) -> DataFrame:
    """What `compare` makes of the rows of left and right (alike columns, `block` among them) of one block.

    The right rows of a block are cut into tiles by their hash; a task holds a
    tile, and the left ones go past it in batches. Each left row is sent once
    for each tile of its block, each right row once for each `stream` left
    ones, so a large block makes many tasks of bounded size. Beyond TILES tiles
    of `tile` rows these grow to eight times that, as each more is a copy of
    the left side. compare gets
    (left rows, right rows) and gives rows of the schema; blocks that only one
    side has give nothing.
    """
    sizes = right.groupBy("block").agg(F.count("*").alias("_r")).join(left.groupBy("block").agg(F.count("*").alias("_l")), "block")
    counts = sizes.select("block", F.least(F.ceil(F.col("_r") / tile), F.greatest(F.lit(TILES), F.ceil(F.col("_r") / (8 * tile)))).cast("int").alias("_tiles"), F.ceil(F.col("_l") / stream).cast("int").alias("_streams"))
    columns = [c for c in left.columns if c != "block"]
    own = F.xxhash64(*columns)
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    sent = left.join(counts, "block").select("block", F.explode(all_of("_tiles")).alias("_tile"), F.pmod(own, F.col("_streams")).cast("int").alias("_stream"), F.lit(1).alias("_side"), *columns)
    held = right.join(counts, "block").select("block", F.pmod(own, F.col("_tiles")).cast("int").alias("_tile"), F.explode(all_of("_streams")).alias("_stream"), F.lit(0).alias("_side"), *columns)
    key = ["block", "_tile", "_stream"]
    dealt = held.unionByName(sent).repartition(*key).sortWithinPartitions(*key, "_side")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, gathered, tile_rows = None, [], None
        for frame in frames:
            runs = (frame[key] != frame[key].shift()).any(axis=1).cumsum()
            for _, part in frame.groupby(runs, sort=False):
                now = tuple(part[key].iloc[0])
                if now != at:
                    at, gathered, tile_rows = now, [], None
                right_rows, left_rows = part[part["_side"] == 0], part[part["_side"] == 1]
                if len(right_rows):
                    gathered.append(right_rows)
                if len(left_rows) and gathered:
                    tile_rows = pd.concat(gathered) if tile_rows is None else tile_rows
                    yield compare(left_rows, tile_rows)

    return dealt.mapInPandas(run, schema)
