"""Intermediate tables that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def whole_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """docs, if their ids are whole numbers (or all null); else a TypeError."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"ids in {id_col} must be whole numbers, not {kind.simpleString()}")
    return docs


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the one that all executors share.

    The cluster names it in spark.checkpoint.dir. Only on one machine (a local
    master) a temporary folder takes its place where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tidewire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidewire-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder (over what lies at `path`, if given) and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, limit: int = 500_000) -> tuple[DataFrame, int]:
    """A written table of ids and its rows; marked for broadcast only if it has at most `limit` rows (some 10 MB)."""
    out = written(df)
    rows = out.count()
    return (F.broadcast(out) if rows <= limit else out), rows
