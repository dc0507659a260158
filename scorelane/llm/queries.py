"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.llm import bpe, chat_format, line_dedup, mixing, nbsvm, pq_dedup, simhash, token_store, topk, url_filter
from scorelane.llm.common import table

#: The rules of op7: host, start of the path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Documents whose score is below this are rejected.
ACCEPT = 0.3


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",")
    return out.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), spans.alias("removed_spans"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"), "quality")
    out = nbsvm.score(docs.select("doc_id", "text"), model)
    held = F.coalesce(nbsvm.fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score").withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["first"], s["end"])), ",")
    return out.select("conv_id", "perspective", F.col("n_turns").cast("long").alias("n_turns"), "text", mask.alias("mask"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("lossless")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that op6 mixes to, one row a source."""
    docs = table(spark, sf_dir, "documents")
    out = mixing.targets(docs.select("source", mixing.words(F.col("text")).alias("size")))
    return out.select("source", "source_size", F.round("target", 6).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_simhash_near_dedup, op3_token_store, op4_quality_classifier, op5_chat_perspectives, op6_mixing, op7_url_filter, op8_exact_top_k, op9_byte_bpe, op10_embedding_near_dedup, mix_targets)
}

#: Windows are compared as texts, not as hashes; ids are unique in the tables it runs on.
OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, pos, ls[pos + 1:pos + 3] AS w
  FROM (SELECT doc_id, ls, unnest(range(greatest(len(ls) - 2, 1))) AS pos FROM lines)
), counted AS (
  SELECT doc_id, pos, w, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS occurrence FROM windows
  WHERE len(list_filter(w, lambda x: trim(x, ' ') <> '')) > 0
), covered AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(pos, pos + len(w))) AS p FROM counted WHERE occurrence > 1)
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) AS z, count(*) AS n FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM covered) GROUP BY doc_id, g
), spans AS (
  SELECT doc_id, string_agg(a || '-' || z, ',' ORDER BY a) AS removed_spans, sum(n) AS n_removed FROM runs GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.p) AS text
  FROM (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS p FROM lines) l ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.p = c.p GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(len(l.ls), 0)::BIGINT AS n_lines,
  coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.removed_spans, '') AS removed_spans
FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN spans s ON d.doc_id = s.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP5_SQL = r"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, nullif(role, '') AS role, coalesce(text, '') AS text FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role IS NOT NULL AND role <> 'system'
), cut AS (
  SELECT s.conv_id, perspective, turn, role, s.text, coalesce(role = perspective, false) AS own,
    '<|im_start|>' || CASE WHEN coalesce(role = 'system', false) THEN 'system' WHEN coalesce(role = perspective, false) THEN 'assistant'
      ELSE 'user name=' || regexp_replace(coalesce(role, 'unknown'), '[\r\n]|<\|', '_', 'g') END || chr(10) AS top,
    replace(s.text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, (sum(length(top) + length(body)) OVER w)::BIGINT AS stop FROM cut
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, count(*) AS n_turns,
  string_agg(top || body, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS text,
  coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY stop) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, perspective
"""

OP7_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
split AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), best AS (
  SELECT n.page_id, n.url, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM named) n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  GROUP BY n.page_id, n.url
)
SELECT n.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM named n LEFT JOIN best b ON n.page_id = b.page_id AND n.url = b.url
"""

OP8_SQL = r"""
WITH rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10_SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9::DOUBLE
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM pairs p WHERE p.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN found ON a = vec_id
"""

#: The level of sources that share is the largest of those that result if the sources of the smallest ratios are stopped.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source
), weighed AS (SELECT *, (1 + (sid - 1) % 3)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS top, sum(source_size) OVER () AS total FROM per
), stopped AS (
  SELECT *, (total - coalesce(sum(top) OVER (ORDER BY top / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY top / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
)
SELECT source, source_size, round(least(weight * (SELECT max(level) FROM stopped), top), 6) AS target FROM stopped
"""

SQL: dict[str, str] = {"op10_embedding_near_dedup": OP10_SQL, "mix_targets": MIX_SQL, "op1_line_dedup": OP1_SQL, "op5_chat_perspectives": OP5_SQL, "op7_url_filter": OP7_SQL, "op8_exact_top_k": OP8_SQL}
