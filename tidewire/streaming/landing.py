"""The archive as a stream: landed items in, upserts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.archive import fits, item_id


def new_items(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Items with ids, each id once within the watermark."""
    rows = fits(stream).withColumn("id", item_id(*(F.col(c) for c in ("site_id", "source", "title", "url"))))
    return rows.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["id"])


def counts_by_hour(stream: DataFrame, key: str, at: str = "published_at", late: str = "2 hours") -> DataFrame:
    """(key, hour, n) of a stream with late rows."""
    return stream.withWatermark(at, late).groupBy(key, F.window(at, "1 hour")).count().select(key, F.col("window.start").alias("hour"), F.col("count").alias("n"))


def upserting(stream: DataFrame, upsert: Callable[[DataFrame, Column], None], checkpoint: str, order: tuple[str, ...] = ("published_at", "id")) -> DataStreamWriter:
    """Hands each micro-batch, with its order of arrival as `pos` and its time as `batch_at`, to `upsert`.

    A batch that is run again gets the same: its time is the one that the
    checkpoint holds for it, and its order follows the rows' own columns.
    """
    timed = stream.withColumns({"batch_at": F.current_timestamp(), "pos": F.struct(*order)})

    def each(batch: DataFrame, _: int) -> None:
        upsert(batch, F.col("batch_at"))

    return timed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
