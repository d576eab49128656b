"""The corpus pipeline: quality rules, line dedup, near dedup, source mixing, tokens.

``run(spark, sf_dir)`` applies STAGES in order to the documents. Each stage's result is written as Parquet to the shared
checkpoint folder and read again, so no stage recomputes its predecessors and a lost executor costs one stage's tasks. A result
is removed once the next one is written; the last one that the returned rows are read from stays.

All stages take empty tables, extra columns of any name, and repeated rows; each says what becomes of nulls.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import linededup, minhash, mixing, quality_rules, spm
from loomset.session import prepare, remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated probability of good quality reaches the threshold; null and blank texts go, null keys don't matter."""
    prepare(spark)
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line only where it occurs first; documents left without text, and null texts, go; null keys stay as they are."""
    prepare(spark)
    out = linededup.dedup_lines(docs)
    return out.where("length(text) > 0")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near duplicates; null keys and null texts stay."""
    prepare(spark)
    return minhash.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of equal-token blocks, as often as the target weights ask for, in the order of the mix.

    The columns are those of the documents, so the order is that of the rows, file after file. Null keys, null and blank texts go.
    """
    prepare(spark)
    return mixing.mix(docs, in_order=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the best segmentation, the scores of the n best, and whether decoding gives the text back.

    ``part`` and ``row`` are the place of the piece in the files of ``docs``, hence in the mix; null where ``docs`` isn't read from files.
    A null text has null ids.
    """
    prepare(spark)
    try:
        placed = docs.select("doc_id", "source", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        placed = docs.select("doc_id", "source", "text", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("row"))
    return spm.encode(placed).select("doc_id", "source", "part", "row", "ids", "n_tokens", "scores", "exact")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("source mixing", mixed), ("sentencepiece", tokens)]

#: SQL can't express the classifier, the sketches or the lattice search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, source, part, row, ids, n_tokens, scores, exact."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
