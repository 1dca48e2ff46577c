"""The corpus pipeline: five stages, each applying one operator to all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Stage texts are what the stage before left of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspan.llm.bpe import bpe_decode, bpe_encode
from quantspan.llm.decontaminate import decontaminate
from quantspan.llm.linededup import line_dedup
from quantspan.llm.neardup import near_duplicates
from quantspan.llm.quality import keep_quality
from quantspan.llm.shared import Collected, Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents below this probability of good quality go; lower than the query's 0.7, as a lost clean document
#: costs more than a poor one that stays.
LEAST_QUALITY = 0.5
#: One or two repeated lines go from so many words on.
LEAST_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """NB-SVM quality classifier: documents that it rejects go."""
    return keep_quality(docs.select(COLUMNS), docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=LEAST_QUALITY)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Winnowing: runs of three lines or of 50 words or more that stand earlier go, and documents of which nothing is left."""
    out = line_dedup(docs.select(COLUMNS), window=3, least_words=LEAST_WORDS)
    out = out.where(~((F.col("n_removed") > 0) & ~F.col("kept_text").rlike(r"\S")))
    changed = F.col("n_removed") > 0
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates, five words and similarity 0.8: the smallest id of each group stays."""
    gone = near_duplicates(docs, shingle_words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of what is left, and what they decode to."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_decode(bpe_encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_runs), ("minhash_near_dedup", near_copies), ("decontamination", benchmarks), ("byte_bpe", tokens)]

#: The classifier's scores and the tokenizer's merges can't be written in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, before = Workspace(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Collected() as tables:
            docs = work.table(stage(spark, docs, sf_dir), name)
            tables.close()  # the stage's rows are written
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
