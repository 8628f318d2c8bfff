"""The queries of this subpackage: name -> f(spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm import boilerplate, mixing, mojibake, neardup, neighbours, packing, residue, split
from corpuskiln.llm.queries_sql import SQL  # noqa: F401
from corpuskiln.tables import read


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of docs and texts of chunks as (kind, id, text)."""
    docs = read(spark, folder, "docs").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("content").alias("text"))
    chunks = read(spark, folder, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text")
    return docs.unionByName(chunks)


def _limit(spark: SparkSession, folder: str, use: str) -> tuple[int, int]:
    row = read(spark, folder, "size_limits").filter(F.col("use_name") == use).select("max_tokens", "overlap_tokens").first()
    return row["max_tokens"], row["overlap_tokens"]


def _pieces(spark: SparkSession, folder: str, use: str) -> DataFrame:
    return split.split_oversized(_texts(spark, folder), "text", *_limit(spark, folder, use))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that come out as more than one piece."""
    return (
        _pieces(spark, folder, "chunk")
        .filter("piece.chunk_index = 1")
        .select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"))
        .distinct()
    )


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all docs and chunks under the smaller limit; a chunk's repeated rows give one set of pieces."""
    return (
        _pieces(spark, folder, "chunk_small")
        .select("kind", "id", "piece.*")
        .dropDuplicates(["kind", "id", "chunk_index"])
    )


def p1_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all docs and chunks under the limit of chunks."""
    return _pieces(spark, folder, "chunk").select("kind", "id", "piece.*").dropDuplicates(["kind", "id", "chunk_index"])


def p1_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """How many pieces under the limit of chunks begin at each kind of cut."""
    return p1_chunks(spark, folder).filter("chunk_index > 0").groupBy("kind", "cut").agg(F.count("*").alias("pieces"))


def p1_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Of every doc and chunk: its length as the pieces tile it, whether all are within the limit, and numbered without gaps."""
    limit, _ = _limit(spark, folder, "chunk")
    return p1_chunks(spark, folder).groupBy("kind", "id").agg(
        F.sum(F.col("end") - F.col("start")).alias("chars"), (F.max("size") <= limit).alias("within"), (F.max("chunk_index") + 1 == F.count("*")).alias("dense")
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.expanded_pairs(*neardup.near_duplicates(_texts(spark, folder), words=3, threshold=0.7, least=30))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Group and number of links of every doc and chunk, with the default measure of five words and 0.8; texts without
    five words are grouped by equal words, and empty and null ones stand alone."""
    texts = _texts(spark, folder)
    return neardup.with_short(texts, neardup.grouped(*neardup.near_duplicates(texts)))


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """Number of different texts that each doc and chunk is a near-duplicate of."""
    return p2_groups(spark, folder).select(F.col("kind").alias("item_kind"), "id", "links")


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_bodies(read(spark, folder, "docs").filter(F.col("metadata.file_type") == "html"), "doc_id", "content")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _bodies(spark, folder).select(F.col("id").alias("doc_id"), F.explode("outside").alias("line_no")).distinct()


def p3_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return _bodies(spark, folder).select(F.col("id").alias("doc_id"), "body")


def _restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.restore_encoding(read(spark, folder, "docs"), "doc_id", "content")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _restored(spark, folder).filter("garbled > 0").select(F.col("id").alias("doc_id")).distinct()


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The affected docs with their text put right as far as possible."""
    return _restored(spark, folder).filter("garbled > 0").select(F.col("id").alias("doc_id"), "garbled", "lost", F.col("restored").alias("content"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.nearest_vectors(read(spark, folder, "chunks"), "chunk_id", "embedding"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_containers(read(spark, folder, "documents"), "doc_id", "text", _limit(spark, folder, "container")[0])


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    capacity = _limit(spark, folder, "container_small")[0]
    return packing.fill_report(packing.fill_containers(read(spark, folder, "documents"), "doc_id", "text", capacity), capacity)


def p6_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document: whether it is in containers, whether its pieces are all there, and whether these hold no more than the capacity."""
    capacity = _limit(spark, folder, "container")[0]
    placed = packing.fill_containers(read(spark, folder, "documents"), "doc_id", "text", capacity).withColumnRenamed("id", "doc_id")
    return placed.groupBy("doc_id").agg(
        F.bool_and(F.col("container").isNotNull()).alias("placed"),
        (F.max("piece") + 1 == F.count("*")).alias("complete"),
        F.coalesce(F.max("used") <= capacity, F.lit(True)).alias("within"),
    )


def p6_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the smaller containers by optimal buckets and, beside it, by a single bucket, which is best fit."""
    capacity = _limit(spark, folder, "container_small")[0]
    docs = read(spark, folder, "documents")
    both = [packing.fill_report(packing.fill_containers(docs, "doc_id", "text", capacity, buckets=n), capacity).withColumn("buckets", F.lit(n)) for n in (16, 1)]
    return both[0].unionByName(both[1])


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(read(spark, folder, "documents"), read(spark, folder, "mix_targets"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(p7_mixture(spark, folder), read(spark, folder, "mix_targets"))


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Of every wanted source: whether no document is taken too often, and whether its share is right: that of the common
    cut to within one document, or all that its repeats allow."""
    targets = read(spark, folder, "mix_targets")
    sized = mixing.sized_documents(read(spark, folder, "documents"), targets, "doc_id", "text", "source", mixing.DEFAULT_VOCABULARY)
    report = p7_report(spark, folder).join(sized.groupBy("source").agg(F.sum("tokens").alias("there"), F.max("tokens").alias("largest")), "source", "left")
    spent = F.coalesce(F.col("tokens") >= F.col("there") * F.col("max_repeats"), F.lit(True))
    cut = report.agg(F.min(F.when(~spent, (F.col("tokens") + F.col("largest")) / F.col("target_share"))).alias("cut"))
    fair = spent | (F.col("tokens") / F.col("target_share") < F.col("cut"))
    return report.join(F.broadcast(cut)).select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within"), fair.alias("fair"))


def _residue(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find_residue(read(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _residue(spark, folder).filter("kind is not null").select(F.col("id").alias("doc_id")).distinct()


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without residue, with their text."""
    docs = read(spark, folder, "documents")
    clean = _residue(spark, folder).filter("kind is null").select(F.col("id").alias("doc_id"))
    return docs.join(clean, "doc_id", "left_semi")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_chunks": p1_chunks, "p1_cuts": p1_cuts, "p1_whole": p1_whole, "p2_found": p2_found, "p2_groups": p2_groups, "p2_links": p2_links, "p3_found": p3_found, "p3_bodies": p3_bodies, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found,
           "p6_containers": p6_containers, "p6_report": p6_report, "p6_placed": p6_placed, "p6_compare": p6_compare, "p7_kept": p7_kept, "p7_mixture": p7_mixture, "p7_report": p7_report,
           "p8_found": p8_found, "p8_clean": p8_clean}
