"""Sets of words that share most of what they have, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written


def alike_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(words, other): all pairs of sets (column words, distinct rows) of left and right whose Jaccard is `least` or more.

    Words are put in the order of how many sets have them. Two sets of that
    Jaccard share one of each other's first n - ceil(least n) + 1 words, so
    only these become keys: common words rarely do, and no pair is lost. Sets
    travel with their keys as numbers of words, meet at the first word that
    they share, and only where enough words can follow it are they checked.
    Empty sets are like none. No side is broadcast: files tell little of how
    large sets are in memory.
    """
    sides = left.select("words", F.lit(True).alias("l"), F.lit(False).alias("r")).union(right.select("words", F.lit(False), F.lit(True)))
    sets = sides.where(F.size("words") > 0).groupBy("words").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    sets = written(sets.withColumn("set", F.monotonically_increasing_id()))
    named = sets.select("set", F.explode("words").alias("w"))
    rarity = written(named.groupBy("w").agg(F.count("*").alias("n")).orderBy("n", "w").select("w", F.monotonically_increasing_id().alias("code")))
    coded = named.join(rarity.hint("merge"), "w").groupBy("set").agg(F.array_sort(F.collect_list("code")).alias("o"))
    coded = written(sets.select("set", "l", "r").join(coded.hint("merge"), "set"))

    def keyed(side: str, name: str, words: str, place: str) -> DataFrame:
        size = F.size("o")
        first = F.slice("o", F.lit(1), size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1)
        return coded.where(side).select(F.col("set").alias(name), F.col("o").alias(words), F.posexplode(first).alias(place, "w"))

    a, b = F.size("o"), F.size("p")
    enough = F.lit(least / (1 + least)) * (a + b) - 1e-9
    may = (a >= F.lit(least) * b - 1e-9) & (b >= F.lit(least) * a - 1e-9) & (F.least(a - F.col("i"), b - F.col("j")) >= enough)
    mine, other = keyed("l", "set", "o", "i").alias("m"), keyed("r", "other_set", "p", "j").alias("t").hint("merge")
    met = mine.join(other, (F.col("m.w") == F.col("t.w")) & may).withColumn("common", F.array_intersect("o", "p"))
    shared = F.size("common")
    met = met.where((F.element_at("common", 1) == F.col("m.w")) & (shared >= F.lit(least) * (a + b - shared) - 1e-9)).select("set", "other_set")
    texts = sets.select("set", "words")
    return met.join(texts.hint("merge"), "set").join(texts.select(F.col("set").alias("other_set"), F.col("words").alias("other")).hint("merge"), "other_set").select("words", "other")
