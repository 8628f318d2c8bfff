"""From files to stored documents and chunks, in one job per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions.vectors import hashed_terms
from corpuskiln.operators import chunking, store
from corpuskiln.sources import files
from corpuskiln.tables import hadoop_path, read_if_any, written

DOCS = f"doc_id string, content string, metadata {files.METADATA}"
CHUNKS = f"chunk_id string, parent_doc_id string, chunk_index int, text string, metadata {files.METADATA}, embedding array<double>"


class Store:
    """Documents and chunks as Parquet folders; each batch adds files of its own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        self._finish_healing()
        return read_if_any(self.spark, f"{self.folder}/{name}", schema)

    def docs(self) -> DataFrame:
        return self._read("docs", DOCS)

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    def add(self, docs: DataFrame, chunks: DataFrame) -> None:
        """Chunks first: a document is stored only once its chunks are, so a failure between the two leaves no document
        without chunks, and chunks without a document are ignored and written again by the next run."""
        chunks.write.mode("append").parquet(f"{self.folder}/chunks")
        docs.write.mode("append").parquet(f"{self.folder}/docs")

    def healed(self) -> None:
        """Rewrites docs without those that have no chunks, and chunks without those that have no document. The new folders
        are written whole before they take the place of the old ones, which a later reader completes if it is interrupted."""
        docs, chunks = self.docs(), self.chunks()
        kept = store.without_orphans(docs, chunks)
        with_parent = chunks.join(docs.select(F.col("doc_id").alias("parent_doc_id")), "parent_doc_id", "left_semi").dropDuplicates(["chunk_id"]).select(*chunks.columns)
        with_parent.write.mode("overwrite").parquet(f"{self.folder}/_next/chunks")
        kept.write.mode("overwrite").parquet(f"{self.folder}/_next/docs")
        files_, whole = hadoop_path(self.spark, f"{self.folder}/_whole")
        files_.mkdirs(whole)
        self._finish_healing()

    def _finish_healing(self) -> None:
        files_, whole = hadoop_path(self.spark, f"{self.folder}/_whole")
        if not files_.exists(whole):
            return
        for name in ("chunks", "docs"):
            (_, new), (_, old) = hadoop_path(self.spark, f"{self.folder}/_next/{name}"), hadoop_path(self.spark, f"{self.folder}/{name}")
            if files_.exists(new):
                files_.delete(old, True)
                files_.rename(new, old)
        files_.delete(whole, True)


def ingest(
    loaded: DataFrame,
    into: Store,
    embed: Callable[[Column], Column] | None = None,
    size: int = config.CHUNK_SIZE,
    overlap: int = config.CHUNK_OVERLAP,
    tokenizer=None,
) -> DataFrame:
    """Stores new documents (doc_id, content, metadata, status, reason) with their chunks; returns (doc_id, status, reason).

    The status is ingested, skipped (stored before, with chunks, or twice in the batch) or failed. A stored
    document without chunks is loaded again. ``embed`` turns the text column into vectors, for a model an Arrow
    or pandas UDF; the default is the offline stand-in.
    """
    stored = store.without_orphans(into.docs(), into.chunks()).select("doc_id", F.lit(True).alias("stored"))
    batch = written(loaded.withColumn("copy", F.row_number().over(_same_document())), "batch")
    status = F.when(F.col("status") == "failed", "failed").when(F.col("stored") | (F.col("copy") > 1), "skipped").otherwise("ingested")
    judged = written(batch.join(stored, "doc_id", "left").withColumn("status", status).drop("stored", "copy"), "judged")
    new = judged.filter("status = 'ingested'").select("doc_id", "content", "metadata")
    chunks = chunking.recursive_chunks(new, size, overlap, tokenizer)
    embed = embed or (lambda text: hashed_terms(text, config.EMBEDDING_DIMS))
    fresh = new.join(into.docs().select("doc_id"), "doc_id", "left_anti")  # healed documents are stored already
    into.add(fresh, chunks.withColumn("embedding", embed(F.col("text"))))
    return judged.select("doc_id", "status", "reason")


def _same_document():
    return Window.partitionBy("doc_id").orderBy("metadata.source_file")


def ingest_folder(spark: SparkSession, folder: str, into: Store, processed_at: Column | None = None, **options) -> DataFrame:
    """Loads and stores all files below a folder; (doc_id, status, reason) per file."""
    return ingest(files.documents(files.scan(spark, folder), processed_at if processed_at is not None else F.current_timestamp()), into, **options)


def ingest_file(spark: SparkSession, path: str, into: Store, processed_at: Column | None = None, **options) -> DataFrame:
    """The same for one file; raises FileNotFoundError if it is none."""
    if not hadoop_path(spark, path)[0].isFile(hadoop_path(spark, path)[1]):
        raise FileNotFoundError(path)
    one = spark.read.format("binaryFile").load(path).select(F.lit(path).alias("path"), "content")
    return ingest(files.documents(one, processed_at if processed_at is not None else F.current_timestamp()), into, **options)
