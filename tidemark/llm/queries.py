"""The contract queries: each reads its whole table, applies one operator and
returns the digest columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.flatgraph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lmscore import score

    return score(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.linededup import digest

    return digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.annsearch import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import detect

    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_language": op2_language,
        "op3_quality": op3_quality,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_lm_score": op5_lm_score,
        "op6_packing": op6_packing,
        "op7_line_dedup": op7_line_dedup,
        "op8_simhash": op8_simhash,
        "op9_nearest": op9_nearest,
        "op10_toxicity": op10_toxicity,
    }


#: Brute force over all pairs of distinct vectors, and the smallest vec_id that links reach.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS e,
    coalesce(list_count(embedding) = len(embedding) AND isfinite(list_max(embedding)) AND isfinite(list_min(embedding)) AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0), false) AND vec_id IS NOT NULL AS good
  FROM embeddings),
near AS (SELECT a.r AS a, b.r AS b, b.vec_id FROM v a JOIN v b ON a.good AND b.good AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reached(r, node) AS (SELECT r, r FROM v UNION SELECT reached.r, near.b FROM reached JOIN near ON near.a = reached.node),
least AS (SELECT reached.r, min(v.vec_id) AS component_id FROM reached JOIN v ON v.r = reached.node GROUP BY reached.r),
n AS (SELECT a AS r, count(*) AS n_links FROM near GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least USING (r) LEFT JOIN n USING (r)
"""

#: DuckDB's levenshtein counts bytes, so letters beyond ASCII become unused control characters.
LETTERS = "èñÑéÉßÇÊíêüÖÍÜÈöÓçäÄó"
CONTROLS = "||".join(f"chr({i})" for i in [*range(1, 10), *range(11, 11 + len(LETTERS) - 9)])
#: Brute force over all pairs of distinct lines of nearly one length; links with lines of up to 9
#: characters, which remove nothing, are counted by themselves.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id, text) AS copy FROM documents),
l AS (SELECT doc_id, text, copy, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM d WHERE text IS NOT NULL),
c AS (SELECT * FROM l WHERE length(line) >= 1 AND trim(line) <> ''),
f AS (SELECT line, min({{'i': coalesce(doc_id, -9223372036854775807), 'p': place, 't': text, 'c': copy}}) AS first, length(line) AS n, translate(line, '{LETTERS}', {CONTROLS}) AS flat FROM c GROUP BY line),
p AS (SELECT a.line AS x, b.line AS y, a.first AS fx, b.first AS fy FROM f a JOIN f b ON a.line < b.line AND b.n BETWEEN a.n - 2 AND a.n + 2 WHERE a.n > 9 AND b.n > 9 AND levenshtein(a.flat, b.flat) <= 2),
e AS (SELECT line, count(*) AS links, bool_or(later) AS later FROM (SELECT x AS line, fx > fy AS later FROM p UNION ALL SELECT y, fy > fx FROM p) GROUP BY line),
s AS (SELECT a.line, count(*) AS shorts FROM f a JOIN f b ON a.line <> b.line AND b.n BETWEEN a.n - 2 AND a.n + 2 WHERE a.n <= 11 AND b.n <= 11 AND (a.n <= 9 OR b.n <= 9) AND levenshtein(a.flat, b.flat) <= 2 GROUP BY a.line),
m AS (SELECT c.doc_id, c.text, c.copy, c.place, coalesce(links, 0) AS links, coalesce(shorts, 0) AS shorts, coalesce(later, false) OR first <> {{'i': coalesce(c.doc_id, -9223372036854775807), 'p': c.place, 't': c.text, 'c': c.copy}} AS goes FROM c JOIN f USING (line) LEFT JOIN e USING (line) LEFT JOIN s USING (line)),
k AS (SELECT l.doc_id, l.text, l.copy, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed, sum(coalesce(links, 0)) AS n_links, sum(coalesce(shorts, 0)) AS n_short_links, coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (NOT coalesce(goes, false)), '') AS kept
  FROM l LEFT JOIN m ON m.doc_id IS NOT DISTINCT FROM l.doc_id AND m.text = l.text AND m.copy = l.copy AND m.place = l.place GROUP BY l.doc_id, l.text, l.copy)
SELECT doc_id, n_lines, n_removed, CAST(n_links AS BIGINT) AS n_links, sha256(kept) AS text_sha256, CAST(n_short_links AS BIGINT) AS n_short_links FROM k
UNION ALL SELECT doc_id, 0, 0, 0, sha256(''), 0 FROM d WHERE text IS NULL
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query: neither models nor tokenizers nor seeded XXH64 can."""
    return {"op1_embedding_dedup": OP1_SQL, "op7_line_dedup": OP7_SQL}
