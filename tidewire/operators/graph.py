"""Written tables between rounds, and connected components of links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the folder that all executors share (spark.checkpoint.dir) and reads it back, which cuts its lineage.

    Only on one machine (a local master) a temporary folder takes its place
    where the setting is missing.
    """
    return _written(df, shared_folder(df.sparkSession))


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name under the shared one."""
    return f"{_shared(spark)}/tidewire-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tidewire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of a link (a, b) can reach.

    Rounds of two steps: each node's larger neighbours hang on its smallest
    one, then its smaller ones do. The number of rounds grows with the
    logarithm of the longest path; a round is two combinable minima and two
    equi-joins, which adaptive execution splits at hot nodes. Rounds take turns
    in two folders, so no more than two of them are kept.
    """
    folders = [shared_folder(links.sparkSession) for _ in range(2)]
    edges = _written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folders[0])
    before = None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())) != before and now[0]:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        hung = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = hung.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        ends = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        folders.reverse()
        edges = _written(hung.join(least, F.col("a") == F.col("n")).select(ends.alias("a"), F.col("m").alias("b")).distinct(), folders[0])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
