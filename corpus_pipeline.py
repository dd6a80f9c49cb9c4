"""The corpus pipeline: stages over ``documents``, each written and reread by the runner.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``. The line stage drops documents of which no line is left,
unless they were blank already; the near-duplicate stage keeps the smallest id of each group.

Defined cases, beside those of the operators: an empty table stays empty; null and empty texts pass every
stage; rows that repeat an id share its fate in the near-duplicate and decontamination stages and are
judged one by one in the others; null ids pass; columns that ``documents`` has beside its own pass
through unchanged, whatever their names; very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm import byte_bpe, decontaminate, line_dedup, minhash_dedup, toxicity
from groundwell.llm.queries import VOCABULARY
from groundwell.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Columns of the documents that are named like the counts keep their values.
    aside = {c: f"{c} of the input" for c in docs.columns if c in ("n_lines", "n_kept", "n_removed")}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(aside)).where("n_removed = 0 or trim(text) <> ''").drop("n_lines", "n_kept", "n_removed")
    out = out.withColumnsRenamed({new: old for old, new in aside.items()})
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.encode_decode(docs.select("doc_id", "text"), vocabulary=public_tokenizers.path(VOCABULARY), pattern=public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: Learnt scores and similarity groups are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
