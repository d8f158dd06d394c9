"""Nested rows made fit for print, and what in a JSON payload isn't."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cut, redacted
from ..functions.urls import public
from ..functions.vocabulary import SENSITIVE_KEYS, SENSITIVE_QUERY_KEYS

SUMMARY_CHARS = 360
SUMMARIES = ("summary", "preview", "description")
# What looks like a secret.
SECRETS = [
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}\b", r"(?i)\bsk-(?!hynix(?:\b|-))[A-Za-z0-9_-]{20,}\b",
]


def bare(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def sanitized(df: DataFrame, redact: bool = True) -> DataFrame:
    """df with sensitive columns and fields null, texts redacted, URLs public and summaries cut, at every depth of its schema.

    Without `redact` texts stay as they are and URLs that aren't http(s) too.
    One projection: structs, arrays and map values are walked on the schema.
    """
    return df.select(*(_clean(F.col(f"`{f.name}`"), f.dataType, f.name, redact).alias(f.name) for f in df.schema.fields))


def _clean(value: Column, kind: T.DataType, name: str, redact: bool) -> Column:
    if bare(name) in SENSITIVE_KEYS:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StringType):
        text = redacted(value) if redact else value
        plain = cut(text, SUMMARY_CHARS) if bare(name) in SUMMARIES else text
        # A URL is made public first: a login before its host is no mail address.
        shown = redacted(public(value)) if redact else public(value)
        return F.when(value.rlike(r"(?i)^\s*https?://"), shown).otherwise(plain)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_clean(value[f.name], f.dataType, f.name, redact).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType, "", redact))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        safe = F.map_filter(value, lambda k, _: ~F.regexp_replace(F.lower(k), "[^a-z0-9]", "").isin(SENSITIVE_KEYS))
        return F.transform_values(safe, lambda _, x: _clean(x, kind.valueType, "", redact))
    return value


def _leaves(bodies: pd.Series) -> pd.Series:

    def each(body):
        try:
            left = [(json.loads(body), "$", "")]
        except (TypeError, ValueError, RecursionError):
            return []
        out = []
        while left:
            value, path, key = left.pop()
            if value in (None, "", False, 0, [], {}):
                continue
            out.append({"path": path, "key": key, "value": value if isinstance(value, str) else None, "text": isinstance(value, str)})
            if isinstance(value, dict):
                left.extend((child, f"{path}.{k}", str(k)) for k, child in reversed(value.items()))
            elif isinstance(value, list):
                left.extend((child, f"{path}[{k}]", "") for k, child in reversed(list(enumerate(value))))
        return out

    return pd.Series([each(b) for b in bodies])


def leaves(body: Column) -> Column:
    """Every member and element of a JSON body that holds something: its path, key, and its value if it is a text."""
    return F.pandas_udf(_leaves, "array<struct<path:string,key:string,value:string,text:boolean>>")(body)


def issues(payloads: DataFrame) -> DataFrame:
    """(name, path, issue) of payloads (name, body as JSON): sensitive keys that hold something, secrets, URLs with credentials, fragments or sensitive parameters."""
    rows = payloads.select("name", F.explode(leaves(F.col("body"))).alias("x")).select("name", "x.*")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    url = F.col("value").rlike(r"(?i)^\s*https?://")
    pairs = F.split(F.regexp_extract("value", r"\?([^#]*)", 1), "&")
    open_keys = F.filter(pairs, lambda p: plain(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), p)).isin(SENSITIVE_QUERY_KEYS) & p.rlike("=."))
    found = F.array_compact(F.array(
        F.when(plain(F.col("key")).isin(SENSITIVE_KEYS), "sensitive field"), F.when(F.col("value").rlike("|".join(SECRETS)), "secret"), F.when(url & F.col("value").rlike(r"^\s*[A-Za-z]+://[^/?#]*@"), "credentials"),
        F.when(url & F.col("value").rlike("#."), "fragment"), F.when(url & (F.size(open_keys) > 0), "parameter"),
    ))
    return rows.select("name", "path", F.explode(found).alias("issue"))


def reconciled(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, declared, actual, ok): counts that a payload tells against those that its rows give; what is on one side alone fails."""
    both = declared.join(actual, "name", "full_outer")
    return both.select("name", "declared", "actual", F.coalesce(F.col("declared") == F.col("actual"), F.lit(False)).alias("ok"))


def dropped(before: DataFrame, after: DataFrame, most: float = 0.7) -> DataFrame:
    """(before, after, drop, ok): how much smaller a snapshot is than the one before."""
    one = before.agg(F.count("*").alias("before")).join(after.agg(F.count("*").alias("after")))  # two tables of one row
    drop = F.when(F.col("before") > 0, F.greatest(F.lit(0.0), (F.col("before") - F.col("after")) / F.col("before"))).otherwise(0.0)
    return one.withColumn("drop", F.round(drop, 4)).withColumn("ok", drop <= most)
