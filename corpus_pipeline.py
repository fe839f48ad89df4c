"""From raw documents to token ids: language, near copies, personal data, mix, tokens.

Each stage takes all rows that its predecessor kept. Between stages the rows
are written as Parquet in the folder of spark.checkpoint.dir and read again.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cooframe.llm import bpe, langid, mixing, near_dedup, pii
from cooframe.llm.shared import written

#: Least cosine with a language's profile for a document to stay; letters at random have one of 0.03 or so.
LEAST_SCORE = 0.04
KEY = "pipeline"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or unlike every learned language, go; all others stay as they are, repeated rows too."""
    profiles = langid.fit(docs, ~langid.held_out("doc_id"))
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = langid.predict(own, profiles, keep=("row",))
    if not profiles:  # no document has a language to learn from: only texts without a letter go
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays, once; texts without words and rows without doc_id have no copies."""
    found = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    kept = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__kept_id"))).drop("__kept_id")
    return kept.dropDuplicates(["doc_id", "text"])


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms of the same format; null texts stay null, no row goes."""
    own = pii.pseudonymise(docs.select("text", F.struct(*docs.columns).alias("row")), KEY)
    return own.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document taken twice is two rows. A null source is a source; a text without words has copies as its rank says."""
    return mixing.mixed(docs, seed="pipeline")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_chars`` for every row of the mix, in the public word-end vocabulary; null texts have no ids."""

    def counted(batches):
        for b in batches:
            counts = [pc.list_value_length(b.column(1)).cast(pa.int64()), b.column(1), pc.utf8_length(b.column(2)).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts], ["doc_id", "n_tokens", "ids", "decoded_chars"])

    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), counted, "doc_id long, n_tokens long, ids array<int>, decoded_chars long")


STAGES = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("PII", pseudonymise),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: No SQL says language profiles, Feistel networks or BPE; tests hold each operator against brute force and run() by what its stages must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
