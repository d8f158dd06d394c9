"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers (modulo a prime): anagrams
share it, whatever the order of their letters, and removing a letter takes its
value off. So words that differ by one added or removed letter meet where one's
key less a letter's value is the other's key, and words that differ by one
exchanged letter where both keys less one letter's value each are equal. What
differs lies in one half of a word and the other half is the same, so that half
is part of the join key: anagrams in another order rarely meet, and no near
pair is lost. The order of letters is verified on the pairs that do meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Keys are kept below this prime, so that very long words don't overflow.
MODULUS = (1 << 61) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def anagram_key(word: Column) -> Column:
    """Of letters up to U+00FF: no two exchanges of one letter add the same."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, x: (total + letter_value(x)) % F.lit(MODULUS))


def occurrences(docs: DataFrame, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) for each run of letters of each text, A-Z lower-cased; a run loses a letter where `every` divides its checksum with its document's id.

    Runs are of A-Z, a-z and U+00C0 to U+00FF. The checksum h is the crc32 of
    `<id>:<run>` (a null id counts as empty); the letter is h modulo the length.
    """
    low = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(low, F.lit("([a-z\\x{C0}-\\x{FF}]+)"), 1)).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("i", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, without).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs; counts are combined before the shuffle."""
    words = occurrences(docs, id_col=id_col, text_col=text_col).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _part(word: Column, start: Column, size: Column) -> Column:
    return F.substring(word, start + 1, size)


def _keys(words: DataFrame, spots: Column) -> DataFrame:
    """(word, n, at): at is a hash of each of the spots (length, side, equal half, key) where a word can meet others."""
    return words.select("word", "n", F.explode(F.transform(spots, lambda s: F.xxhash64(s["length"], s["side"], s["half"], s["key"]))).alias("at"))


def _spot(length: Column, side: int, half: Column, key: Column) -> Column:
    return F.struct(length.alias("length"), F.lit(side).alias("side"), half.alias("half"), key.alias("key"))


def _less_one(word: Column, key: Column, length: Column, cut: Column, skip: int) -> Column:
    """Spots of a word with one letter taken off: those of its right part, where the left half is equal, and of its left part (`skip` letters longer), where the right one is."""
    size = F.length(word)
    left, right = _part(word, F.lit(0), cut + skip), _part(word, cut, size)
    off = lambda part, side, half: F.transform(F.array_distinct(F.split(part, "")), lambda x: _spot(length, side, half, F.pmod(key - letter_value(x), F.lit(MODULUS))))
    return F.concat(off(right, 0, _part(word, F.lit(0), cut)), off(left, 1, _part(word, cut + skip, size)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, m): all pairs, both ways round, of words (word, n) that differ by exactly one inserted, deleted or replaced code point."""
    words = words.withColumns({"key": anagram_key(F.col("word")), "size": F.length("word")})
    word, key, size = F.col("word"), F.col("key"), F.col("size")
    half = F.floor(size / 2).cast("int")
    whole = _keys(words, F.array(_spot(size, 0, _part(word, F.lit(0), half), key), _spot(size, 1, _part(word, half, size), key)))
    shorter = F.floor((size - 1) / 2).cast("int")
    removed = _keys(words, _less_one(word, key, size - 1, shorter, 1))
    exchanged = _keys(words, _less_one(word, key, size, half, 0))
    other = [F.col("word").alias("other"), F.col("n").alias("m"), "at"]
    added = removed.join(whole.select(*other), "at")
    swapped = exchanged.join(exchanged.select(*other), "at").where("word < other")
    met = added.union(swapped).where(F.levenshtein("word", "other", 1) == 1)
    # A pair can meet at two spots (a doubled letter in the middle).
    return met.select(F.explode(F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))).alias("p")).select("p.*").repartition("word").dropDuplicates(["word", "other"])


def followed(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): where the forms of forms end. A round doubles the steps; forms must not go round in circles."""
    roots = written(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return roots


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least least_length code points that occurs least_count times.

    n_near counts the words that differ by one inserted, deleted or replaced
    code point. form is the one of these with the largest n (form_n; of equals
    the first in code-point order) if that is at least `times` the word's n,
    else both are null; root is where the forms of forms end, the word itself
    without any. Null and empty texts have no words, repeated rows count each,
    a null id counts as empty, other columns play no part; an empty table
    gives no rows.
    """
    words = written(vocabulary(docs, least_length, least_count, id_col, text_col))
    pairs = near_pairs(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    found = best.select("word", "n_near", F.col("b.other").alias("other"), (-F.col("b.m")).alias("m"))
    formed = F.col("m") >= times * F.col("n")
    told = written(
        words.join(found, "word", "left").select("word", F.when(formed, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("m")).alias("form_n"))
    )
    roots = followed(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
