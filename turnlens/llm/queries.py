"""The queries opN_<name> of the corpus operators, with their production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lines, merkle, mixing, neardup, pii, pivots, quality, substring, suffix, tokens, trie, warc
from ._shared import documents

#: The vocabulary that measures fertility and counts tokens, unless the session's spark.turnlens.vocabulary names another
#: file of base64 ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def vocabulary(spark: SparkSession) -> str:
    return spark.conf.get("spark.turnlens.vocabulary", VOCABULARY)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pfair mix of the sources by the square root of their sizes, in blocks of 64 documents."""
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source"), alpha=0.5, block_rows=64)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality.quality_rules(docs, vocabulary(spark)).drop("text")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=3, threshold=85)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.substring_dedup(documents(spark, sf_dir)).drop("kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), vocabulary(spark))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (
        op1_mix_sources, op2_quality_rules, op3_minhash_near_dedup, op4_personal_data, op5_line_dedup,
        op6_decontaminate, op7_warc_round_trip, op8_substring_dedup, op9_suffix_dedup, op10_token_counts,
        op11_embedding_near_dedup, op12_merkle_manifest, op13_conversation_trie,
    )
    return {q.__name__: q for q in own} | {"pipeline": corpus_pipeline.run}


#: Payload digests: DuckDB's sha1 gives hex; five hex digits are four digits of base 32.
_OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(5 * (3 - k % 4) AS INT)) & 31 AS INT) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d JOIN f USING (hex)
"""


#: All pairs of a label; components as the smallest id reachable.
_OP11 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY a) USING (vec_id)
"""

#: CRC-32 of a decimal, with the table {t} of its 256 steps.
_CRC_TABLE = """SELECT list(list_reduce(list_prepend(k, range(8)),
  lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) AS r(k)"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + length({s})), lambda k: CAST(ord(substr({s}, k, 1)) AS BIGINT))),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""


def _merkle_sql(levels: int = 5) -> str:
    """Trees by lang of at most 8 ** levels leaves, unrolled by level; the tree of the subroots has one level (8 langs)."""
    field = lambda x: f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text])) + ")"
    steps, folds, proof, last = [], [], [], "f0"
    for k in range(levels):
        more = f"n > {8**k}"
        steps.append(f"""l{k + 1} AS MATERIALIZED (SELECT g, n, i // 8 AS i, CASE WHEN {more} THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
  FROM l{k} GROUP BY g, n, i // 8),
s{k} AS MATERIALIZED (SELECT g, i,
  CASE WHEN {more} THEN coalesce(string_agg(d, '' ORDER BY i) OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS a,
  CASE WHEN {more} THEN coalesce(string_agg(d, '' ORDER BY i) OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS b FROM l{k})""")
        folds.append(f"f{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (x, p), CASE WHEN s.a IS NULL THEN x ELSE sha256(s.a || x || s.b) END AS x, p || coalesce(s.a || s.b, '') AS p FROM f{k} f JOIN s{k} s ON f.g = s.g AND f.i // {8**k} = s.i)")
    return f"""
WITH crc AS ({_CRC_TABLE}),
h AS MATERIALIZED (SELECT doc_id, coalesce('x' || lang, '') AS g, {leaf("text")} AS leaf,
  CASE WHEN {_CRC.format(s="CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf("text")} END AS x
  FROM documents, crc),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h),
l0 AS MATERIALIZED (SELECT g, n, i, leaf AS d FROM o),
{", ".join(steps)},
t AS MATERIALIZED (SELECT g, d AS subroot, count(*) OVER () AS many,
  coalesce(string_agg(d, '' ORDER BY g) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(d, '' ORDER BY g) OVER (ORDER BY g ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM l{levels}),
f0 AS MATERIALIZED (SELECT doc_id, leaf, g, i, x, '' AS p FROM o),
{", ".join(folds)},
r AS (SELECT doc_id, leaf, subroot, CASE WHEN many > 1 THEN sha256(t.a || subroot || t.b) ELSE subroot END AS root,
  sha256(p || t.a || t.b) AS proof_sha256, CASE WHEN many > 1 THEN sha256(t.a || x || t.b) ELSE x END AS folded_root FROM f{levels} JOIN t USING (g))
SELECT *, folded_root = root AS verified FROM r
"""


_OP13 = f"""
WITH crc AS ({_CRC_TABLE}),
o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, ts, {_CRC.format(s="CAST(c AS VARCHAR)")} % 6 AS h FROM o, crc),
e AS (SELECT h.c, list_concat(coalesce(o.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o ON o.c = h.c - h.c % 100),
n AS MATERIALIZED (SELECT p, len(p) AS depth, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(ts) = d), '')) AS ends_sha256
  FROM (SELECT c, ts, d, ts[1:d] AS p FROM e, unnest(range(len(ts) + 1)) AS u(d)) GROUP BY p),
k AS MATERIALIZED (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[depth].x) ELSE 0 END AS saved FROM n LEFT JOIN k USING (p)),
s AS MATERIALIZED (SELECT p[1:d] AS p, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM f, unnest(range(depth + 1)) AS u(d) GROUP BY 1)
SELECT f.conv_id, f.depth, CASE WHEN f.depth > 0 THEN q.conv_id END AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s USING (p) JOIN f q ON q.p = f.p[1:greatest(f.depth - 1, 0)]
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_round_trip": _OP7, "op11_embedding_near_dedup": _OP11, "op12_merkle_manifest": _merkle_sql(), "op13_conversation_trie": _OP13}
