"""Confidence in retrieved chunks, and the gate on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions import scores


def with_source(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits`` with the file of their parent document as ``source`` where they have none; left join on parent_doc_id.

    ``docs`` has doc_id and metadata.source_file; an existing, non-empty ``source`` column of ``hits`` wins.
    """
    files = docs.select(F.col("doc_id").alias("parent_doc_id"), F.col("metadata.source_file").alias("_file"))
    known = F.when(F.col("source") != "", F.col("source")) if "source" in hits.columns else F.lit(None).cast("string")
    return hits.join(files, "parent_doc_id", "left").withColumn("source", F.coalesce(known, F.col("_file"))).drop("_file")


def parts(as_of: Column, df: DataFrame) -> dict[str, Column]:
    """The four sub-scores of rows with source, retrieved_by, rerank_score and maybe date (a time, or ISO 8601 text)."""
    kinds = dict(df.dtypes)
    date = F.lit(None).cast("timestamp") if "date" not in kinds else scores.as_time(F.col("date")) if kinds["date"] == "string" else F.col("date")
    return {
        "freshness": scores.freshness(date, as_of),
        "trust": scores.trust(F.col("source")),
        "overlap": scores.overlap(F.col("retrieved_by")),
        "relevance": scores.relevance(F.col("rerank_score")),
    }


def with_confidence(df: DataFrame, as_of: Column, weights: dict[str, float] | None = None) -> DataFrame:
    return df.withColumn("confidence_score", scores.weighted(parts(as_of, df), weights))


def gate(df: DataFrame, threshold: float = config.CONFIDENCE_THRESHOLD, tie: str = "rank") -> DataFrame:
    """Rows at or over the threshold, numbered per query by falling confidence (``position``), ties in old order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence_score"), F.asc(tie))
    return df.filter(F.col("confidence_score") >= F.lit(threshold)).withColumn("position", F.row_number().over(order))
