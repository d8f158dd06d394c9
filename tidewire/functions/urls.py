"""URL functions as built-in expressions.

A query string is read as forms are: `&` parts pairs, empty parts go, `+` and
%XX are decoded and what is left is encoded anew, so equal queries get equal
text. An escape that can't be decoded stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, stripped
from .vocabulary import IDENTITY_KEYS, SENSITIVE_QUERY_KEYS, TRACKING_KEYS

SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _parts(url: Column) -> Column:
    """scheme, host, path and query of a URL, each found once; an empty scheme where it isn't one."""
    of = lambda k: F.regexp_extract(url, SPLIT, k)
    return F.struct(of(1).alias("scheme"), of(2).alias("host"), of(3).alias("path"), of(4).alias("query"), url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://").alias("slashed"), url.alias("whole"))


def _key(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def _coded(text: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(raw: Column, keep) -> Column:
    """The pairs whose key `keep` accepts, encoded anew."""
    pairs = F.filter(F.split(raw, "&"), lambda p: (p != "") & keep(_key(p)))
    return F.array_join(F.transform(pairs, lambda p: F.concat(_coded(_key(p)), F.lit("="), _coded(p.substr(F.length(_key(p)) + 2, F.length(p))))), "&")


def _assembled(p: Column, host: Column, query: Column) -> Column:
    authority = F.when(p["slashed"], F.concat(F.lit("//"), host)).otherwise("")
    tail = let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(F.lower(p["scheme"]), F.lit(":"), authority, p["path"], tail)


def host_of(url: Column) -> Column:
    """Lower-cased authority, with port and credentials as they stand; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(stripped(url), SPLIT, 2), F.lit("")))


def _kept(url: Column, keep) -> Column:
    """Scheme and host lower-cased, the pairs that `keep` accepts, no fragment, no trailing slashes; text without a scheme as it is."""
    parts = let(url, _parts)
    return let(parts, lambda p: F.when(p["scheme"] == "", p["whole"]).otherwise(F.rtrim(_assembled(p, F.lower(p["host"]), _query(p["query"], keep)), F.lit("/"))))


def normalized(url: Column) -> Column:
    """Scheme and host lower-cased; tracking keys, fragment and trailing slashes gone. Text without a scheme is only stripped."""
    tracked = lambda k: F.lower(k).startswith("utm_") | F.lower(k).isin(TRACKING_KEYS)
    return _kept(stripped(url), lambda k: ~tracked(k))


def canonical(url: Column) -> Column:
    """The normalized URL with only the keys that name an article."""
    return _kept(normalized(url), lambda k: F.lower(k).isin(IDENTITY_KEYS))


def public(url: Column) -> Column:
    """Without credentials, fragment and secret-like keys; what isn't http(s) becomes empty."""
    sensitive = lambda k: F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(k), k)), "[^a-z0-9]", "").isin(SENSITIVE_QUERY_KEYS)
    shown = lambda p: _assembled(p, F.regexp_replace(F.lower(p["host"]), r"^.*@", ""), _query(p["query"], lambda k: ~sensitive(k)))
    return let(let(stripped(url), _parts), lambda p: F.when(F.lower(p["scheme"]).isin("http", "https"), shown(p)).otherwise(""))


def joined(base: str, href: Column) -> Column:
    """A link as it stands on a page of `base` (scheme and host, no path)."""
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit(base.split("//")[0]), href)).when(href == "", F.lit(base)).otherwise(F.concat(F.lit(base), F.when(F.startswith(href, F.lit("/")), "").otherwise("/"), href))
