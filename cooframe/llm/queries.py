"""Queries over whole tables, one for each operator, and their SQL where SQL can say them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, langid, licenses, mixing, near_dedup, pii, quality, token_store, topk


#: Key of the pseudonyms of these queries; a deployment passes its own.
KEY = "queries"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), KEY)
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join(F.array_sort(F.array_distinct("pii.kind")), ",").alias("kinds"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op4_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~langid.held_out("doc_id"))
    return quality.score(docs, model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.stored(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.digests(spark, store)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs, ~langid.held_out("doc_id")))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def _token_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = bpe.id_lists(batch.column(1)), batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), _token_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), seed="mix").select("doc_id", "size", "source_size", "target", "taken")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.to_json("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL = {
    "op9_pareto_mix": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM d GROUP BY source
), r AS (SELECT *, source_size::DOUBLE * 2 AS stop, source_size::DOUBLE * 2 / w AS ratio FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(stop) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, least(stop, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) * w, stop)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS copies FROM t
), m AS (
  SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS rest, target - floor(copies)::BIGINT * source_size AS wanted FROM e
), k AS (
  SELECT source, len(bin(size)) AS digits, sum(size)::BIGINT AS words, greatest(1, 32 - len(bin(size)))::BIGINT AS weight FROM d GROUP BY ALL
), f AS (
  SELECT k.*, (wanted - coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY digits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(words * weight) OVER (PARTITION BY k.source ORDER BY digits ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS scale FROM k JOIN m ON k.source IS NOT DISTINCT FROM m.source AND rest > 0
), g AS (SELECT source, arg_min(scale, digits) AS scale FROM f WHERE scale * weight <= 1 GROUP BY source
), c AS (
  SELECT d.*, m.source_size, m.target, m.whole, m.rest, m.wanted, m.rest / (1 - m.rest) AS odds, least(1.0::DOUBLE, coalesce(g.scale * greatest(1, 32 - len(bin(size))), 1.0)) AS chance
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source
), q AS (SELECT *, CASE WHEN chance >= 1 THEN 0.0 ELSE u / (1 - u) / (chance / (1 - chance)) * odds END AS scaled FROM c
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY scaled / (1 + scaled), doc_id) - size / 2 AS middle FROM q
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rest > 0 AND middle <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM p""",
    "op4_dual_tree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_minhash_near_dedup": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l ON l.node = d.doc_id""",
}
