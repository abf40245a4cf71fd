"""From raw documents to packed sequences: toxicity, line dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a DataFrame; all but
the last return the columns of documents.  `run` writes each result as Parquet in the shared
checkpoint folder and reads it again for the next stage, so a lost executor costs one stage at most;
a stage's table goes once the next one is written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linededup, neardup, packing, pii, toxicity
from tessera.llm.common import remove, table, use_checkpoint_dir

NEAR = 80  #: least similarity of near duplicates in percent; 42 bands of 6 miss 3 in 10^6 of such pairs


def sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if there is such a column, as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the toxicity cut go."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents of which nothing else is left."""
    mark = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    done = linededup.deduplicated(docs, mark=mark)
    return sized(done.where(F.col(mark).isNull() | F.col("text").rlike(r"\S")).drop(mark))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of similarity NEAR or more, stays."""
    return neardup.deduplicated(docs, NEAR)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the names of their kinds."""
    return sized(pii.redacted(docs, pii.learn(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece of a document."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select(*packing.COLUMNS)


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("personal_data", redact), ("packing", pack)]
#: Models and tokenizers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
