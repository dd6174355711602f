"""A corpus pipeline: quality, near duplicates, repeated passages, source mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`, and any
others that docs have, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemetry.llm._tables import shared_dir, table, write
from linemetry.llm.bpe import encode_documents
from linemetry.llm.mixing import mixed_documents
from linemetry.llm.ngram_join import ngram_join
from linemetry.llm.quality import score_quality
from linemetry.llm.queries import vocabulary_path
from linemetry.llm.substring_dedup import without_repeats

#: Words and percent of a near duplicate's shingles; words of a repeated passage.
NEAR_WORDS, NEAR_PERCENT, PASSAGE_WORDS = 5, 80, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. Null and empty texts are judged by their
    statistics; every row by itself, so repeated ones share their fate."""
    return score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id. Texts without words and
    rows with a null doc_id are nobody's duplicate and stay; rows that repeat a doc_id share its fate."""
    gone = ngram_join(docs, NEAR_WORDS, NEAR_PERCENT).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has too. No row goes; rows with a
    null doc_id lose nothing, and rows that repeat a doc_id aren't smaller than each other."""
    return without_repeats(docs, PASSAGE_WORDS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or parts of them, that the mix takes; one row for each time. Texts without words go,
    as the mix takes nothing of them; a null source is a source of its own."""
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and digests; a row for every row."""
    return encode_documents(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: The classifier can't be expressed in SQL. Tests hold near_duplicates, repeated_passages and tokens
#: against brute force and the library, source_mix against a replay of its blocks, and quality
#: against its pairwise sum and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/linemetry/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        write(stage(spark, docs, sf_dir), f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
