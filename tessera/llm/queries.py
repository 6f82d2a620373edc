"""The registered queries of this subpackage, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, kneser_ney, mixing, topics, toxicity
from .ann import search
from .common import crc_mod, sha256_hex, stored
from .line_dedup import line_dedup
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .url_rules import judge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    own = topics.read(docs, topics.fit(docs)).select("doc_id", "source", "lang", "topic", "n_tokens", F.xxhash64("text").alias("text_hash"))
    own = stored(own, "counted")  # texts are read once
    mixed = mixing.with_probability(own, mixing.fit(own, ["source", "lang", "topic"], alpha=0.7, keep=0.5))
    return mixed.withColumn("drawn", mixing.drawn(["doc_id", "text_hash"], "probability", seed=17)).drop("text_hash")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"), "matches")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", F.col("extracted").alias("text"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, rule="common", min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept")).alias("kept_sha256"))


OP6_SQL = r"""
WITH line AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id
"""

def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, length=50).select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


OP7_SQL = r"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(words, s, s + 49), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM split WHERE len(words) >= 50)),
least AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN least USING (h) WHERE doc_id > least),
word AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM split)),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL) AS kept
  FROM word LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    model = kneser_ney.train(docs.filter(~held_out))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


#: (host, path, action)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, default="allow").drop("url")


OP10_SQL = f"""
WITH rules(host, path, action) AS (VALUES {", ".join(map(repr, URL_RULES))}),
split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
fits AS (
  SELECT s.host, s.path, arg_max({{'rule': r.host || r.path, 'action': r.action}}, length(r.host) + length(r.path)) AS best
  FROM (SELECT DISTINCT host, path FROM split) s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY ALL)
SELECT page_id, s.host, s.path, f.best.rule AS rule, coalesce(f.best.action, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.host = f.host AND s.path = f.path
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mixing": op1_mixing, "op2_decontaminate": op2_decontaminate, "op3_html_text": op3_html_text, "op4_ann": op4_ann, "op5_toxicity": op5_toxicity, "op6_line_dedup": op6_line_dedup, "op7_substring_dedup": op7_substring_dedup, "op8_simhash": op8_simhash, "op9_kneser_ney": op9_kneser_ney, "op10_url_rules": op10_url_rules}
ORACLE_SQL: dict[str, str] = {"op6_line_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op10_url_rules": OP10_SQL}
