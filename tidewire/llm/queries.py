"""The queries of this package, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_classes

    return simhash_classes(_table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import learn, scored

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, _table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs).select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import shared_folder
    from .token_store import stored_digests, write_store

    store = shared_folder(spark)
    write_store(_table(spark, sf_dir, "documents"), store, _tokenizer("word_bpe_49k.json"), end_id=2)
    return stored_digests(spark, store)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digests

    return digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), spans=True)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP7_SQL = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from vectors q join vectors c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
where rank <= 5
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    out = judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import without_repeats

    left = without_repeats(_table(spark, sf_dir, "documents"), length=50)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


OP9_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as w from documents
), windows as (
  select doc_id, s, sha256(array_to_string(list_slice(w, s, s + 49), ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from words)
), first as (
  select h, min(doc_id) as least from windows group by h
), gone as (
  select distinct doc_id, unnest(range(s, s + 50)) as k from windows join first using (h) where least < doc_id
), lists as (
  select doc_id, list(k) as ks from gone group by doc_id
), kept as (
  select doc_id, w, case when ks is null then w else list_select(w, list_filter(range(1, len(w) + 1), lambda x: not list_contains(ks, x))) end as k
  from words left join lists using (doc_id)
)
select doc_id, len(w) as n_words, len(w) - len(k) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages"))


OP10_SQL = r"""
with heads as (
  select page_id, case when contains(url, '://') then regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0, 's') else '' end as head from pages
), parts as (
  select page_id, translate(split_part(coalesce(head, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         case when contains(head, '/') then substr(head, instr(head, '/')) else '' end as path
  from heads
), rules(rule_host, rule_path, said) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fit as (
  select page_id, host, path, rule_host || rule_path as rule, said
  from parts left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
), best as (
  select *, row_number() over (partition by page_id, host, path order by length(rule) desc) as n from fit
)
select page_id, host, path, rule, coalesce(said, case when regexp_full_match(host || path,
  '[^/]*casino[^/]*/.*|[^/]*poker[^/]*/.*|[^/]*viagra[^/]*/.*|[^/]*\.xxx/.*|.*/login[^/]*|.*/cart/.*|.*\.exe', 's') then 'block' else 'allow' end) as verdict
from best where n = 1
"""


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality_model": op2_quality_model,
        "op3_mixing": op3_mixing,
        "op4_token_counts": op4_token_counts,
        "op5_token_store": op5_token_store,
        "op6_pieces": op6_pieces,
        "op7_top_k": op7_top_k,
        "op8_quality_rules": op8_quality_rules,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_url_filter": op10_url_filter,
        "op11_license_scan": op11_license_scan,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    from .vector_codes import codes_sql

    return {"op7_top_k": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op10_url_filter": OP10_SQL, "op13_vector_codes": codes_sql()}
