"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder, written


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node that has a link, the smallest node it can reach.

    Each round hooks every node's larger neighbours to its smallest one and
    then its smaller neighbours likewise, until nothing moves: the number of
    rounds grows with the logarithm of the longest path. Links stay in tables;
    minima are combined before each shuffle, and the joins that fetch them are
    plain equi-joins that adaptive execution splits when a node is hot. Rounds
    take turns in two folders, so no more than two of them are kept. Null
    ends and loops count as no link. An empty table gives no rows.
    """
    folders = [shared_folder(links.sparkSession) for _ in range(2)]
    edges = written(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        folders[0],
    )
    stamp = _stamp(edges)
    while stamp[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = (
            both.join(least, F.col("a") == F.col("n"))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = (
            large.join(least, F.col("a") == F.col("n"))
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        folders.reverse()
        edges = written(small, folders[0])
        now = _stamp(edges)
        if now == stamp:
            break
        stamp = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
