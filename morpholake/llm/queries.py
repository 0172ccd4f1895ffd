"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morpholake.llm import attribution, bpe, chat, hnsw, lm, packing, pii, simhash, sketch, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings")).drop("recall")


#: All pairs of a label by brute force; the graphs must find the same.
OP4_SQL = """
WITH RECURSIVE n AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
g AS (SELECT * FROM n WHERE label IS NOT NULL AND norm > 0 AND isfinite(norm)),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
r AS (SELECT a AS node, b AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
k AS (SELECT node, min(reach) AS least_ FROM r GROUP BY node),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least_, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least_, vec_id)) AS kept
FROM embeddings LEFT JOIN k ON node = vec_id LEFT JOIN c ON a = vec_id
"""

#: Tools that op5's calls name. The table of conversations holds no calls of its own, so the query reads every user's
#: turn as one (its tool, and what is wrong with its arguments, follow from the text's length) and every assistant's
#: turn as the result of the call one turn before; a call comes after the one two turns before.
TOOLS = {
    "search": {"text": ("string", True), "n": ("integer", True)},
    "translate": {"text": ("string", True), "n": ("integer", False)},
    "summarise": {"text": ("string", True), "n": ("number", False), "style": ("string", False)},
}


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    name = F.element_at(F.array(*[F.lit(t) for t in [*TOOLS, "unheard"]]), (F.col("size") % 4 + 1).cast("int"))
    number = F.when(F.col("size") % 5 == 0, F.concat(F.lit('"'), F.col("size"), F.lit('"'))).otherwise(F.col("size").cast("string"))
    spoken = F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{(.*)\}$", 1)
    arguments = F.concat(F.lit("{"), F.when(F.col("size") % 7 == 0, F.lit('"zeal": true')).otherwise(spoken), F.lit(', "n": '), number, F.lit("}"))
    link = lambda back: F.concat(F.lit("c"), F.col("turn") - back)
    calls = turns.where("role = 'user'").select("conv_id", "turn", link(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.array(link(2)).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", link(1).alias("call_id"), F.col("text").alias("content"))
    found = chat.link_tool_calls(calls, results, TOOLS)
    return found.select("conv_id", "call_id", "turn", "name", F.col("level").cast("bigint").alias("level"), "n_calls", "n_results", "result_turn", "valid", F.array_join("errors", ",").alias("errors"), F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


OP5_SQL = """
WITH RECURSIVE turns AS (SELECT conv_id, turn, role, text, length(text) AS size FROM conversations),
c AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, 'c' || (turn - 2) AS after,
    ['search', 'translate', 'summarise', 'unheard'][1 + size % 4] AS name,
    CASE WHEN size % 7 = 0 THEN NULL ELSE text END AS said, size,
    CASE WHEN size % 5 = 0 THEN '"' || size || '"' ELSE size::VARCHAR END AS n,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n_calls
  FROM turns WHERE role = 'user'),
calls AS (SELECT * FROM c WHERE k = 1),
r AS (
  SELECT conv_id, turn, 'c' || (turn - 1) AS call_id, text AS content,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n_results
  FROM turns WHERE role = 'assistant'),
results AS (SELECT * FROM r WHERE k = 1),
levels AS (
  SELECT conv_id, call_id, 0 AS level FROM calls WHERE NOT EXISTS (SELECT 1 FROM calls o WHERE o.conv_id = calls.conv_id AND o.call_id = calls.after)
  UNION ALL
  SELECT calls.conv_id, calls.call_id, level + 1 FROM levels JOIN calls ON calls.conv_id = levels.conv_id AND calls.after = levels.call_id),
joined AS (
  SELECT coalesce(calls.conv_id, results.conv_id) AS conv_id, coalesce(calls.call_id, results.call_id) AS call_id,
    calls.turn AS turn, results.turn AS result_turn, name, level, n_calls, n_results, content, said, n, size, calls.call_id IS NOT NULL AS is_call
  FROM calls FULL JOIN results ON calls.conv_id = results.conv_id AND calls.call_id = results.call_id
  LEFT JOIN levels ON levels.conv_id = calls.conv_id AND levels.call_id = calls.call_id),
told AS (
  SELECT *, CASE WHEN NOT is_call THEN 'orphan' WHEN name = 'unheard' THEN 'tool' ELSE array_to_string(list_filter([
    CASE WHEN said IS NULL THEN 'missing:text' END,
    CASE WHEN size % 5 = 0 THEN 'type:n' END,
    CASE WHEN said IS NULL THEN 'unknown:zeal' END], lambda x: x IS NOT NULL), ',') END AS errors
  FROM joined)
SELECT conv_id, call_id, coalesce(turn, result_turn) AS turn, name, level::BIGINT AS level, coalesce(n_calls, 0) AS n_calls,
  coalesce(n_results, 0) AS n_results, result_turn, errors = '' AS valid, errors,
  sha256('{' || CASE WHEN is_call THEN '"arguments":{"n":' || n || CASE WHEN said IS NULL THEN ',"zeal":true' ELSE ',"text":' || to_json(said)::VARCHAR END || '},' ELSE '"arguments":[null],' END
    || '"call_id":"' || call_id || '"' || coalesce(',"level":' || level, '') || coalesce(',"name":"' || name || '"', '')
    || coalesce(',"result":' || to_json(content)::VARCHAR, '') || coalesce(',"turn":' || turn, '') || '}') AS json_sha256
FROM told
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edit_likeness(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"), redacted=False)
    written = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [number(kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(written(pii.BASE).cast("binary"), 256).alias("base_sha256"), written(pii.KINDS).alias("spans"), F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", "n_backoff", F.round("log_score", 4).alias("log_score"))


OP10_SQL = """
WITH spoken AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
n AS (SELECT doc_id, len(w) AS n_tokens, sum(len(w)) OVER () AS total FROM spoken),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM spoken),
p AS (
  SELECT doc_id, place, word AS w, lag(word) OVER d AS v, lag(word, 2) OVER d AS u FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
c1 AS (SELECT w, doc_id, count(*) AS own, sum(count(*)) OVER (PARTITION BY w) AS n FROM p GROUP BY w, doc_id),
c2 AS (SELECT v, w, doc_id, count(*) AS own, sum(count(*)) OVER (PARTITION BY v, w) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w, doc_id),
c3 AS (SELECT u, v, w, doc_id, count(*) AS own, sum(count(*)) OVER (PARTITION BY u, v, w) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, w, doc_id),
k AS (
  SELECT p.doc_id, p.v, p.u, greatest(c1.n - c1.own, 0.5)::DOUBLE / greatest(total - n_tokens, 1) AS s1,
    c2.n - c2.own AS n2, (c2.n - c2.own)::DOUBLE / nullif(h1.n - h1.own, 0) AS s2,
    c3.n - c3.own AS n3, (c3.n - c3.own)::DOUBLE / nullif(h2.n - h2.own, 0) AS s3
  FROM p JOIN n ON n.doc_id = p.doc_id JOIN c1 ON c1.doc_id = p.doc_id AND c1.w = p.w
  LEFT JOIN c2 ON c2.doc_id = p.doc_id AND c2.v = p.v AND c2.w = p.w
  LEFT JOIN c3 ON c3.doc_id = p.doc_id AND c3.u = p.u AND c3.v = p.v AND c3.w = p.w
  LEFT JOIN c1 h1 ON h1.doc_id = p.doc_id AND h1.w = p.v
  LEFT JOIN c2 h2 ON h2.doc_id = p.doc_id AND h2.v = p.u AND h2.w = p.v),
s AS (
  SELECT doc_id,
    CASE WHEN n3 > 0 THEN ln(s3) WHEN n2 > 0 THEN ln(s2) + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
      ELSE ln(s1) + CASE WHEN v IS NULL THEN 0 WHEN u IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS score,
    CASE WHEN n3 > 0 THEN 0 WHEN n2 > 0 THEN (u IS NOT NULL)::INT ELSE (v IS NOT NULL)::INT + (u IS NOT NULL)::INT END AS back
  FROM k)
SELECT n.doc_id, n_tokens::BIGINT AS n_tokens, coalesce(sum(back), 0)::BIGINT AS n_backoff, round(coalesce(sum(score), 0.0), 4) AS log_score
FROM n LEFT JOIN s ON s.doc_id = n.doc_id GROUP BY n.doc_id, n_tokens
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_token_counts, op4_embedding_dedup, op5_tool_calls, op6_fingerprints, op7_simhash, op8_packing, op9_pii, op10_lm_scores)}

ORACLE_SQL: dict[str, str] = {"op4_embedding_dedup": OP4_SQL, "op5_tool_calls": OP5_SQL, "op10_lm_scores": OP10_SQL}
