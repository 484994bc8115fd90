"""The corpus pipeline: documents go through the stages in order, each written as Parquet and reread by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sizewise.llm.common import ROW_JOIN, staged, table
from sizewise.llm.decontaminate import without_contaminated
from sizewise.llm.line_dedup import dedup_lines
from sizewise.llm.minhash import near_duplicates
from sizewise.llm.mixing import mix_to_weights
from sizewise.llm.queries import toxicity_labels
from sizewise.llm.toxicity import judge_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; a null or empty text, repeated rows and null ids are judged as they are.

    Columns of any name pass unchanged, also those named like the results of the operator.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))
    judged = judge_toxicity(rows, toxicity_labels(spark, sf_dir), ["junk", "toxic"], "doc_id", "text")
    return judged.where("NOT rejected").select("document.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go; ``n_chars``, where there is one, follows the text. Every document stays, if need be empty."""
    cut = dedup_lines(docs, "doc_id", "text")
    if "n_chars" not in docs.columns:
        return cut.select(*docs.columns)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.withColumn("n_chars", F.coalesce(n_chars, "n_chars")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, with all its rows."""
    gone = near_duplicates(docs, "doc_id", "text").where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint(ROW_JOIN), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to equal shares; ``copy`` and ``shuffle_key`` are added."""
    return mix_to_weights(docs, category_col="source", id_col="doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: The toxicity and near-duplicate stages have no SQL form; tests hold each stage against its operator's brute force or held-out labels.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
