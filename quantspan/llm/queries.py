"""Thin queries over the standard tables: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .decontaminate import find_leaks
from .hnsw import embedding_duplicates
from .linededup import line_dedup
from .neardup import near_duplicates
from .quality import quality_scores
from .sharding import minimax_shards
from .substrings import remove_repeats
from .toxicity import toxicity_scores
from .warc import warc_round_trip


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_winnowing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents"), window=3)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_read(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_encode(_read(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe_decode(encoded, vocabulary).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.7)


def op6_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op7_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(_read(spark, sf_dir, "documents"), shards=8)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)


def op10_hnsw_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: Every line covered by three lines in a row that stand earlier goes; what is left is hashed.
LINES_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE regexp_matches(line, '\\S')),
w AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS win FROM nb WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w WHERE win IS NOT NULL) WHERE k > 1),
hit AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM rep),
fl AS (SELECT l.doc_id, l.pos, l.line, nb.i, hit.i IS NOT NULL AS gone FROM l LEFT JOIN nb ON l.doc_id = nb.doc_id AND l.pos = nb.pos LEFT JOIN hit ON nb.doc_id = hit.doc_id AND nb.i = hit.i),
ru AS (SELECT doc_id, count(*) AS n FROM hit WHERE (doc_id, i - 1) NOT IN (SELECT (doc_id, i) FROM hit) GROUP BY 1)
SELECT fl.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed, coalesce(any_value(ru.n), 0)::BIGINT AS n_runs, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM fl LEFT JOIN ru ON fl.doc_id = ru.doc_id GROUP BY 1"""


#: Distinct shingle sets meet on their shingles; components are the closure of the links.
NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))]) END AS s FROM w),
one AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY ALL),
e AS (SELECT rep, n, unnest(s) AS x FROM one),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT rep AS a, rep AS b FROM one UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component END AS component_id, CASE WHEN len(s.s) = 0 THEN true ELSE s.doc_id = component END AS kept FROM s LEFT JOIN one ON len(s.s) > 0 AND one.s = list_sort(s.s) LEFT JOIN c ON c.rep = one.rep"""

#: Equal payloads by their text; base32 from the hexadecimal digest, four digits from each five.
WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY 1),
q AS (SELECT p.*, first, row_number() OVER (PARTITION BY p.html, p.page_id) AS k FROM p JOIN f ON p.html = f.html)
SELECT page_id, n AS payload_bytes, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * (g // 4), 5))::BIGINT >> (15 - 5 * (g % 4))) & 31)::INT + 1, 1) FOR g IN range(0, 32)], 'string_agg', '') AS payload_digest,
CASE WHEN page_id = first AND k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first AND k = 1 THEN NULL ELSE first END AS refers_to FROM q"""


def oracle_sql() -> dict[str, str]:
    return {"op2_winnowing_lines": LINES_SQL, "op6_minhash_hamming": NEAR_SQL, "op9_warc_round_trip": WARC_SQL}
