"""The ten queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A shard's limit: so large, or a fortieth of the table where that is less.
SHARD_BYTES, SHARDS = 16 << 20, 40

URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import components

    return components(table(spark, sf_dir, "documents")).drop("fp")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digests, remove_repeats

    return digests(remove_repeats(table(spark, sf_dir, "documents")))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), outputs=())


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return shard(docs, max(1, min(SHARD_BYTES, total // SHARDS)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP6_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM hp LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path
) SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best
"""

OP8_SQL = f"""
WITH k AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents
), lim AS (SELECT greatest(1, least({SHARD_BYTES}, sum(n_bytes) // {SHARDS})) AS most FROM k),
s AS (
  SELECT d, key >> (60 - d) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS n
  FROM k, (SELECT CAST(range AS INTEGER) AS d FROM range(0, 61)) GROUP BY ALL
), leaf AS (
  SELECT doc_id, n_bytes, key, arg_min(s, d) AS s FROM k, s, lim WHERE key >> (60 - d) = prefix AND (b <= most OR n = 1 OR d = 60) GROUP BY doc_id, n_bytes, key
) SELECT doc_id, n_bytes, CASE WHEN s.d = 0 THEN '' ELSE right(lpad(bin(s.prefix), 64, '0'), s.d) END AS shard,
         s.d AS depth, s.b AS shard_bytes, s.n AS shard_docs, s.b > most AS over_limit
FROM leaf, lim
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": OP6_SQL, "op8_sharding": OP8_SQL}
