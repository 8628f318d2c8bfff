"""Keeping documents, chunks, cached answers and traces in tables: insert, replace, expire, heal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions.text import cache_key
from corpuskiln.tables import written


#: tasks that the rows of one frequent key are spread over
SALTS = 16


def latest(df: DataFrame, key: str, at: Column, *ties: Column) -> DataFrame:
    """The newest row per key. Rows are cut to one per key within each task before the shuffle."""
    window = Window.partitionBy(key).orderBy(at.desc_nulls_last(), *ties)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def latest_of_few(df: DataFrame, key: str, at: Column, *ties: Column) -> DataFrame:
    """``latest`` for tables of wide rows with few repeated keys: keys alone are counted by a shuffle, and only rows of
    repeated keys (null ones with them) are sorted; the others stay in their tasks while the repeated keys are few enough to broadcast."""
    repeated = written(df.groupBy(key).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(key), "repeated")
    single = df.join(repeated, df[key].eqNullSafe(repeated[key]), "left_anti")
    return single.unionByName(latest(df.join(repeated, df[key].eqNullSafe(repeated[key]), "left_semi"), key, at, *ties))


def new_rows(incoming: DataFrame, stored: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows whose key is not stored yet, one per key: the first in ``order`` (of all columns that can be ordered, unless given)."""
    fresh = incoming.join(stored.select(key), key, "left_anti")
    order = order or tuple(F.col(f"`{name}`") for name, kind in fresh.dtypes if "map<" not in kind)
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def orphans(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without any chunk, to be deleted and loaded again."""
    return docs.join(chunks.select(F.col("parent_doc_id").alias("doc_id")), "doc_id", "left_anti")


def without_orphans(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.join(chunks.select(F.col("parent_doc_id").alias("doc_id")), "doc_id", "left_semi")


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks): the number of distinct chunks of every document, 0 for orphans."""
    per = chunks.groupBy(F.col("parent_doc_id").alias("doc_id")).agg(F.countDistinct("chunk_id").alias("chunks"))
    return docs.select("doc_id").join(per, "doc_id", "left").fillna(0, ["chunks"])


def ingest_status(incoming: DataFrame, stored_docs: DataFrame, stored_chunks: DataFrame) -> DataFrame:
    """(doc_id, status) of incoming documents: failed without text, skipped if stored with chunks, else ingested."""
    healthy = stored_chunks.select(F.col("parent_doc_id").alias("doc_id")).join(stored_docs.select("doc_id"), "doc_id", "left_semi").distinct().withColumn("stored", F.lit(True))
    blank = F.coalesce(F.regexp_replace("content", r"^\s+", ""), F.lit("")) == ""
    return incoming.join(healthy, "doc_id", "left").select(
        "doc_id", F.when(F.col("stored"), "skipped").when(blank, "failed").otherwise("ingested").alias("status")
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("documents"))


def alive(df: DataFrame, at: str, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Rows younger than the lifetime at ``as_of``, and not from after it."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(1e6)
    return df.filter((age >= 0) & (age < ttl_seconds))


def cached_answers(queries: DataFrame, cache: DataFrame, as_of: Column, ttl_seconds: int = config.CACHE_TTL) -> DataFrame:
    """``queries`` (query_id, query) with cache_key, result and hit. The newest living row of a key counts; a null
    result is a miss."""
    newest = latest(alive(cache, "created_at", as_of, ttl_seconds), "cache_key", F.col("created_at"), F.col("query"))
    asked = queries.withColumn("cache_key", cache_key(F.col("query")))
    # One key may be asked by a third of all queries: these go to SALTS tasks each, and each living answer to those of them that ask for it.
    salted = asked.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)))
    answers = newest.select("cache_key", "result").join(salted.select("cache_key", "_salt").distinct(), "cache_key")
    return salted.join(answers, ["cache_key", "_salt"], "left").drop("_salt").withColumn("hit", F.col("result").isNotNull())


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after a batch of writes: one row per key, the newest."""
    return latest(cache.unionByName(new), "cache_key", F.col("created_at"), F.col("query"))


def trace_stages(traces: DataFrame) -> DataFrame:
    """(trace_id, stage, detail): the stages of each trace, of its newest row; broken or null JSON gives none."""
    newest = latest(traces, "trace_id", F.col("recorded_at"))
    stages = F.from_json("stages", "map<string,string>")
    return newest.select("trace_id", F.explode(stages).alias("stage", "detail"))


def trace_rollup(traces: DataFrame) -> DataFrame:
    """(query, runs, failures, mean_ms, cache_hits) per query text in lower case without outer space.

    Repeated rows count once; null queries form one group; negative durations are unknown. Rows are summed within
    each task first, so one frequent query does not weigh on one task.
    """
    newest = latest(traces, "trace_id", F.col("recorded_at"))
    return (
        newest.withColumn("query", F.lower(F.regexp_replace("query", r"^\s+|\s+$", "")))
        .groupBy("query")
        .agg(
            F.count("*").alias("runs"),
            F.count_if(~F.col("success")).alias("failures"),
            F.round(F.avg(F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))), 9).alias("mean_ms"),
            F.count_if(F.get_json_object("stages", "$.cache.hit") == "true").alias("cache_hits"),
        )
    )
