"""The corpus pipeline: five stages over ``documents``, each with one of the ten operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.  A row whose ``doc_id`` is null
cannot be told from others of that kind and passes the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix.llm.common import scratch_path, table
from jobmix.llm.decontamination import contaminated
from jobmix.llm.line_dedup import dedup_lines
from jobmix.llm.ngram_join import linked
from jobmix.llm.sentencepieces import encode_decode
from jobmix.llm.toxicity import train


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows that a distinct column ``_gone`` names."""
    return docs.join(ids, docs["doc_id"].cast("bigint") == ids["_gone"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (op 6) does not reject; fitted on the labelled rows among them."""
    scored = train(docs, table(spark, sf_dir, "labels")).score(docs)
    return _without(docs, scored.where("predicted = 1").select(F.col("doc_id").alias("_gone")).distinct())


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that later documents repeat are cut from their texts (op 7)."""
    cut = dedup_lines(docs).drop("n_lines", "n_dropped")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (op 4) the document with the smallest id."""
    found = linked(docs).where("doc_id <> component_id")
    return _without(docs, found.select(F.col("doc_id").alias("_gone")).distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (op 3)."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("_gone")).distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded text (op 8)."""
    import public_tokenizers
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# SentencePiece ids and a trained model cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the documents are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
