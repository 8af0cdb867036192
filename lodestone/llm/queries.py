"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table


def op1_piece_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import piece_langid

    return piece_langid.identify(table(spark, sf_dir, "documents"))


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import toxicity_cnn

    return toxicity_cnn.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import chat_format

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    examples = chat_format.expand(chat_format.format_conversations(turns.unionByName(own)), rest=True)
    return chat_format.digests(chat_format.read_examples(examples))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import impact_search

    return impact_search.top_k(table(spark, sf_dir, "embeddings"))


def op9_itq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import itq_links

    return itq_links.links(table(spark, sf_dir, "embeddings"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import dart_minhash

    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import block_labeller

    return block_labeller.extract(table(spark, sf_dir, "pages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import source_mix

    return source_mix.mix(table(spark, sf_dir, "documents")).drop("first", "second")


def op10_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import binary_packing

    return binary_packing.pack(table(spark, sf_dir, "documents"))


def op11_mask_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import mask_ranking

    return mask_ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import compression_bands

    return compression_bands.judge(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import merkle_manifest

    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_piece_langid, op2_toxicity_cnn, op3_chat_format, op4_url_filter, op5_dart_minhash, op6_impact_search, op7_block_labeller, op8_source_mix, op9_itq_links, op10_binary_packing, op11_mask_ranking, op12_compression_bands, op13_merkle_manifest)}

SQL: dict[str, str] = {
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
    + 2 + length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + 8)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op6_impact_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_itq_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings),
w AS (
  SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM w a JOIN w b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION SELECT reach.node, l.v FROM reach JOIN l ON l.u = reach.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id""",
    "op11_mask_ranking": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT doc_id, row, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
held AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, total GROUP BY term),
gain AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) AS gain FROM held JOIN w USING (term), total),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gain USING (term) GROUP BY item_id, row HAVING sum(gain) > 0),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_merkle_manifest": """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS step FROM range(256) r(i)),
d AS (
  SELECT doc_id, lang, sha256(coalesce(strlen((doc_id)::VARCHAR) || ':' || (doc_id)::VARCHAR, '-') || coalesce(strlen((source)::VARCHAR) || ':' || (source)::VARCHAR, '-') || coalesce(strlen((lang)::VARCHAR) || ':' || (lang)::VARCHAR, '-') || coalesce(strlen((n_chars)::VARCHAR) || ':' || (n_chars)::VARCHAR, '-') || coalesce(strlen((text)::VARCHAR) || ':' || (text)::VARCHAR, '-')) AS leaf, sha256(coalesce(strlen((doc_id)::VARCHAR) || ':' || (doc_id)::VARCHAR, '-') || coalesce(strlen((source)::VARCHAR) || ':' || (source)::VARCHAR, '-') || coalesce(strlen((lang)::VARCHAR) || ':' || (lang)::VARCHAR, '-') || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || coalesce(strlen((text)::VARCHAR) || ':' || (text)::VARCHAR, '-')) AS touched,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
t AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, n, pos // 2),
s AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, n, h FROM s
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, n, pos // 2),
a AS (
  SELECT lang, pos AS id, 0 AS level, pos, n, CASE WHEN tampered THEN touched ELSE leaf END AS fold, '' AS proof FROM leaves
  UNION ALL SELECT a.lang, id, a.level + 1, a.pos // 2, (a.n + 1) // 2, CASE WHEN a.pos % 2 = 1 THEN sha256(t.h || fold) ELSE sha256(fold || coalesce(t.h, '')) END, proof || coalesce(t.h, '')
  FROM a LEFT JOIN t ON t.lang IS NOT DISTINCT FROM a.lang AND t.level = a.level AND t.pos = xor(a.pos, 1) WHERE a.n > 1),
b AS (
  SELECT a.lang, id, 0 AS level, s.pos, s.n, fold, proof FROM a JOIN s ON a.n = 1 AND s.lang IS NOT DISTINCT FROM a.lang
  UNION ALL SELECT lang, id, b.level + 1, b.pos // 2, (b.n + 1) // 2, CASE WHEN b.pos % 2 = 1 THEN sha256(u.h || fold) ELSE sha256(fold || coalesce(u.h, '')) END, proof || coalesce(u.h, '')
  FROM b LEFT JOIN u ON u.level = b.level AND u.pos = xor(b.pos, 1) WHERE b.n > 1)
SELECT doc_id, leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.h AS verified
FROM leaves l JOIN b ON b.n = 1 AND b.id = l.pos AND b.lang IS NOT DISTINCT FROM l.lang JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.n = 1""",
}
