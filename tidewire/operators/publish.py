"""Snapshots of a run's tables, all of them switched at once; the archive by days, of which a run writes what it touches.

A run writes its tables beside those of earlier runs and then one row of a
manifest for each part of each table, in one file, last of all. Readers take
the parts that the newest run's rows name, so a run that fails halfway changes
nothing for them. Parts that a run doesn't touch are named again, not written.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import retained, upserted

MANIFEST = "run string, published_at timestamp, name string, part string, path string, rows long"
#: The part of tables that have but one, and that of the archive's rows without a time.
WHOLE, UNSEEN = "", "unseen"


def _day() -> Column:
    return F.coalesce(F.date_format("last_seen_at", "yyyy-MM-dd"), F.lit(UNSEEN))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The newest run's parts of tables; empty before the first run."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    newest = rows.agg(F.max(F.struct("published_at", "run")).alias("n")).select("n.*")
    return rows.join(F.broadcast(newest), ["published_at", "run"]).select(MANIFEST.replace(",", " ").split()[::2])


def snapshot(spark: SparkSession, root: str, name: str, parts: list[str] | None = None) -> DataFrame | None:
    """A table as the newest run left it (of its parts those named, if any are); None where there is none."""
    rows = manifest(spark, root).where(F.col("name") == name)
    rows = rows.where(F.col("part").isin(parts)) if parts is not None else rows
    paths = sorted(r.path for r in rows.select("path").collect())  # one a day of the archive at most
    return spark.read.parquet(*paths) if paths else None


def published(spark: SparkSession, root: str, run: str, now: datetime, tables: dict[str, DataFrame], archive: tuple[DataFrame, list[str]] | None = None) -> None:
    """Writes the tables of a run, then switches to them.

    archive: rows with last_seen_at and the days (yyyy-MM-dd) that these rows
    replace; days that aren't among them stay as they are, those left without
    rows go.
    """
    said = []
    for name, table in tables.items():
        path = f"{root}/runs/{run}/{name}"
        table.write.mode("overwrite").parquet(path)
        said.append((run, now, name, WHOLE, path, spark.read.parquet(path).count()))
    kept = manifest(spark, root).where(F.col("name") == "archive")
    if archive is not None:
        rows, days = archive
        path = f"{root}/runs/{run}/archive"
        rows.withColumn("day", _day()).repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)
        written = spark.read.schema(rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", day string").parquet(path)
        said += [(run, now, "archive", r.day, f"{path}/day={r.day}", r["count"]) for r in written.groupBy("day").count().collect()]
        kept = kept.where(~F.col("part").isin(days)) if days else kept
    told = {(name, part) for _, _, name, part, _, _ in said}
    said += [(run, now, r.name, r.part, r.path, r.rows) for r in kept.collect() if (r.name, r.part) not in told]
    spark.createDataFrame(said, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def archived(spark: SparkSession, root: str, batch: DataFrame, now: datetime, days: int = 21) -> tuple[DataFrame, list[str]]:
    """The archive's rows after a batch, and the days that they replace: for `published`.

    The ids alone are read of all days; rows only of those that hold one of the
    batch's ids. Days that lie wholly before the time kept are replaced by none.
    """
    today = f"{now:%Y-%m-%d}"
    ids = snapshot(spark, root, "archive")
    if ids is None:
        empty = "id string, site_id string, site_name string, source string, title string, url string, published_at timestamp, first_seen_at timestamp, last_seen_at timestamp"
        return retained(upserted(spark.createDataFrame([], empty), batch, now), now, days), [today]
    own = ids.select("id", _day().alias("day"))
    hit = {r.day for r in own.join(batch.select("id").distinct(), "id", "left_semi").select("day").distinct().collect()}
    parts = {r.part for r in manifest(spark, root).where("name = 'archive'").select("part").collect()}
    first = f"{datetime.fromtimestamp(now.timestamp() - days * 86_400, now.tzinfo):%Y-%m-%d}"
    touched = sorted(p for p in parts if p in hit or p in (today, first))
    old = snapshot(spark, root, "archive", touched) if touched else ids.limit(0)
    gone = sorted(p for p in parts if p < first)
    return retained(upserted(old, batch, now), now, days), [*touched, *gone, *([today] if today not in touched else [])]


def archive_in_order(archive: DataFrame) -> DataFrame:
    """Newest sight first, rows without one last."""
    return archive.orderBy(F.col("last_seen_at").desc_nulls_last(), "id")
