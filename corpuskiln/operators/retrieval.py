"""Keyword and vector search for whole sets of queries, and their fusion.

A query set goes to every executor by broadcast after a check of its size; a larger one is searched in parts. The
search itself never shuffles texts and vectors: only counts of asked terms and the best scores of each task and query move.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions.text import terms
from corpuskiln.tables import written

MAX_QUERIES = 20_000


def in_parts(search):
    """Makes a search over a query set (its first argument) one over parts of at most about ``MAX_QUERIES`` queries."""

    @functools.wraps(search)
    def whole(queries: DataFrame, *args, **options) -> DataFrame:
        parts = -(-queries.count() // MAX_QUERIES)
        if parts <= 1:
            return search(queries, *args, **options)
        queries = written(queries, "queries")
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        return functools.reduce(DataFrame.unionByName, (search(queries.filter(part == k), *args, **options) for k in range(parts)))

    return whole


def ranked(df: DataFrame, order: list[Column], limit: int, by: str = "query_id", into: str = "rank") -> DataFrame:
    """The first ``limit`` rows per ``by``, numbered from 1."""
    window = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(into, F.row_number().over(window)).filter(F.col(into) <= limit)


def corpus_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: number of texts and their mean length in terms."""
    return docs.select(F.size(terms(F.col(text_col))).alias("length")).agg(F.count("length").alias("texts"), F.avg("length").alias("mean_length"))


def postings(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(term, id, frequency, length) of every text: the inverted index, to be written partitioned by term."""
    words = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("words"))
    return (
        words.select("id", F.size("words").alias("length"), F.explode("words").alias("term"))
        .groupBy("term", "id", "length")
        .agg(F.count("*").alias("frequency"))
    )


@in_parts
def keyword_search(
    queries: DataFrame,
    docs: DataFrame,
    id_col: str,
    text_col: str = "text",
    limit: int = config.CANDIDATES_PER_METHOD,
    k1: float = config.BM25_K1,
    b: float = config.BM25_B,
) -> DataFrame:
    """(query_id, id, score, rank): the best ``limit`` texts per query by BM25, any of its terms; ties by id.

    ``queries`` has query_id and query. Scores are rounded to six places before they are compared. Texts without
    any term of the query are no hits; null texts count as empty.
    """
    asked = queries.select("query_id", F.array_distinct(terms(F.coalesce("query", F.lit("")))).alias("terms")).filter(F.size("terms") > 0).toArrow()
    of_queries = asked.column("terms").combine_chunks()
    vocabulary = pa.array(sorted(set(of_queries.flatten().to_pylist())), pa.string())
    words = docs.select(F.col(id_col).alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    idf, mean = _term_weights(words, vocabulary)
    wanted = _padded(pc.index_in(of_queries.flatten(), vocabulary), of_queries, len(vocabulary))

    def compare(batches):
        best = _Best(len(wanted), limit, floor=np.nextafter(0, 1))  # over all batches of the task
        step = _block(max(len(wanted), len(vocabulary)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                here = batch.slice(at, step)
                parts = _term_scores(here.column("words"), vocabulary, idf, mean, k1, b)
                total = parts[wanted[:, 0]]
                for k in range(1, wanted.shape[1]):
                    some = int((wanted[:, k] < len(vocabulary)).sum())  # those with so many terms come first
                    total[:some] += parts[wanted[:some, k]]
                best.add(total, here.column("id"))
        yield from best.batches(order)

    order = np.argsort(-of_queries.value_lengths().to_numpy(zero_copy_only=False), kind="stable")
    wanted = wanted[order]
    schema = f"query int, id {dict(docs.dtypes)[id_col]}, score double"
    return _best_of_all(_few_tasks(words).mapInArrow(compare if len(wanted) else _nothing, schema), asked.column("query_id"), queries, limit)


def _term_weights(words: DataFrame, vocabulary: pa.Array) -> tuple[np.ndarray, float]:
    """Inverse document frequency of each term of the vocabulary (0 for those in no text), and the texts' mean length."""
    spark = words.sparkSession
    terms_ = spark.createDataFrame(pa.table({"term": pa.concat_arrays([vocabulary, pa.array([""])])}))  # the empty term stands for the text itself
    found = words.select(F.size("words").alias("length"), F.explode(F.array_append(F.array_distinct("words"), "")).alias("term")).join(F.broadcast(terms_), "term", "left_semi")
    counts = found.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length"))
    whole = F.broadcast(counts.filter("term = ''").select(F.col("df").alias("texts"), (F.col("length") / F.col("df")).alias("mean")))
    got = counts.crossJoin(whole).select("term", "mean", F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).toArrow()
    idf = np.zeros(len(vocabulary))
    at = pc.index_in(got.column("term").combine_chunks(), vocabulary)
    idf[at.drop_null().to_numpy()] = got.column("idf").combine_chunks().filter(at.is_valid()).to_numpy(zero_copy_only=False)
    return idf, (got.column("mean")[0].as_py() if got.num_rows else 0.0)


def _padded(numbers: pa.Array, lists: pa.Array, fill: int) -> np.ndarray:
    """Numbers of the lists' values as rows of equal length."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lengths), max(1, lengths.max(initial=0))), fill)
    out[np.arange(out.shape[1]) < lengths[:, None]] = numbers.to_numpy(zero_copy_only=False)
    return out


def _term_scores(words: pa.Array, vocabulary: pa.Array, idf: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    """BM25 of each term (row) in each text (column); a last row of zeros for no term."""
    lengths = words.value_lengths().to_numpy(zero_copy_only=False)
    term = pc.index_in(words.flatten(), vocabulary)
    text = np.repeat(np.arange(len(words)), lengths)[term.is_valid().to_numpy(zero_copy_only=False)]
    cell, tf = np.unique(term.drop_null().to_numpy().astype(np.int64) * len(words) + text, return_counts=True)
    out = np.zeros((len(vocabulary) + 1, len(words)))
    out.reshape(-1)[cell] = idf[cell // len(words)] * tf / (tf + k1 * (1 - b + b * lengths[cell % len(words)] / mean))
    return out


def _block(rows: int) -> int:
    """Columns of a matrix of so many rows and 32 MB."""
    return max(1, (1 << 22) // max(1, rows))


def _nothing(batches):
    return iter(())


def _few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in no more tasks than cores: each gives back its best, so what moves depends on the cores and not on the rows."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def _best_of_all(scored: DataFrame, names: pa.ChunkedArray, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank) from the best of each task, which name a query by its number in ``names``."""
    kind = queries.schema["query_id"].dataType
    names = queries.sparkSession.createDataFrame(pa.table({"query": pa.array(range(len(names)), pa.int32()), "query_id": names})).select("query", F.col("query_id").cast(kind))
    best = ranked(scored.withColumn("score", F.round("score", 6)), [F.desc("score"), F.asc("id")], limit, by="query")
    return best.join(F.broadcast(names), "query").select("query_id", "id", "score", "rank")


@in_parts
def vector_search(
    queries: DataFrame,
    docs: DataFrame,
    id_col: str,
    vector_col: str = "embedding",
    limit: int = config.CANDIDATES_PER_METHOD,
    dims: int | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the best ``limit`` vectors per query by cosine; ties by id.

    ``queries`` has query_id and vector. Vectors that are null, all zero, or not of ``dims`` values (of the query's
    number of values if not given) are no hits. Exact: every vector is compared with every query of the set, as
    products of matrices in Arrow batches; of each task only possible hits come back.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter(_usable("vector")).toArrow()
    schema = f"query int, id {dict(docs.dtypes)[id_col]}, score double"
    vectors = docs.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(_usable("v"))
    if dims is not None:
        vectors = vectors.filter(F.size("v") == dims)
    sizes = asked.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if asked.num_rows else np.zeros(0, dtype=int)
    sets = {int(n): _rows(asked.filter(pa.array(sizes == n)).column("vector"), int(n)) for n in np.unique(sizes)}
    numbers = {n: np.flatnonzero(sizes == n) for n in sets}

    def compare(batches):
        best = {n: _Best(len(q), limit) for n, q in sets.items()}  # over all batches of the task
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for n, q in sets.items():
                same = batch.filter(pa.array(lengths == n))
                for at in range(0, same.num_rows, step := _block(len(q))):
                    here = same.slice(at, step)
                    best[n].add(q @ _rows(here.column("v"), n).T, here.column("id"))
        for n, kept in best.items():
            yield from kept.batches(numbers[n])

    return _best_of_all(_few_tasks(vectors).mapInArrow(compare, schema), asked.column("query_id"), queries, limit)


class _Best:
    """The best ``limit`` scores of each of ``queries`` queries so far, with all that equal the last at six places; none under ``floor``."""

    def __init__(self, queries: int, limit: int, floor: float = -np.inf):
        self.limit, self.least, self.floor = limit, np.full(queries, -np.inf), floor
        self.row, self.score, self.ids = [], [], []

    def add(self, s: np.ndarray, ids: pa.Array) -> None:
        keep = s >= np.maximum(self.least - 2e-6, self.floor)[:, None]
        if s.shape[1] >= self.limit and np.count_nonzero(keep) > self.limit * len(self.least):
            self.least = np.maximum(self.least, np.partition(s, -self.limit, axis=1)[:, -self.limit])
            keep = s >= np.maximum(self.least - 2e-6, self.floor)[:, None]
        row, col = np.nonzero(keep)
        self.row.append(row)
        self.score.append(s[row, col])
        self.ids.append(ids.take(pa.array(col)))
        if sum(map(len, self.row)) > 4 * self.limit * len(self.least):
            self.result()

    def batches(self, numbers: np.ndarray):
        """What is left, in batches of (query, id, score); ``numbers`` are those of the queries."""
        row, ids, score = self.result()
        for at in range(0, len(row), 100_000):
            here = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[row[here]], pa.int32()), ids[here], pa.array(score[here])], names=["query", "id", "score"])

    def result(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        if not self.row:
            return np.zeros(0, dtype=np.int64), pa.array([], pa.null()), np.zeros(0)
        row, score, ids = np.concatenate(self.row), np.concatenate(self.score), pa.concat_arrays(self.ids)
        order = np.lexsort((-score, row))
        row, score = row[order], score[order]
        start = np.searchsorted(row, np.arange(len(self.least)))
        full = np.flatnonzero(np.diff(np.r_[start, len(row)]) >= self.limit)
        self.least[full] = np.maximum(self.least[full], score[start[full] + self.limit - 1])
        keep = score >= self.least[row] - 2e-6
        self.row, self.score, self.ids = [row[keep]], [score[keep]], [ids.take(pa.array(order[keep]))]
        return self.row[0], self.ids[0], self.score[0]


def _usable(vector: str) -> Column:
    v = F.col(vector)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def _rows(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows of a matrix, each at length one."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1)[:, None]


def fuse_ranks(ranks: DataFrame, k: int = config.RRF_K) -> DataFrame:
    """(query_id, id, rrf_score) from (query_id, id, rank) rows of any number of lists: the sum of 1 / (k + rank)."""
    return ranks.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf_score"))


def fuse_methods(keyword: DataFrame, vector: DataFrame, top_k: int = config.FUSED_TOP_K, k: int = config.RRF_K) -> DataFrame:
    """(query_id, id, rrf_score, retrieved_by, keyword_rank, vector_rank, rank) of the best ``top_k`` hits of both lists.

    Ties go to the keyword list's order, then to the vector list's. Hits with a null or empty id are left out.
    """
    both = keyword.select("query_id", "id", F.col("rank").alias("keyword_rank"), F.lit(None).cast("int").alias("vector_rank")).unionByName(
        vector.select("query_id", "id", F.lit(None).cast("int").alias("keyword_rank"), F.col("rank").alias("vector_rank"))
    )
    fused = (
        both.filter("id <> ''")
        .groupBy("query_id", "id")
        .agg(F.min("keyword_rank").alias("keyword_rank"), F.min("vector_rank").alias("vector_rank"))
        .withColumn("rrf_score", sum((F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in ("keyword_rank", "vector_rank")), F.lit(0.0)))
        .withColumn("retrieved_by", F.filter(F.array(F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("vector_rank").isNotNull(), "vector")), lambda m: m.isNotNull()))
    )
    order = [F.desc(F.round("rrf_score", 12)), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("vector_rank")]
    return ranked(fused, order, top_k)


def hybrid_search(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, vector_col: str, top_k: int = config.FUSED_TOP_K, candidates: int = config.CANDIDATES_PER_METHOD) -> DataFrame:
    """Keyword and vector search and their fusion; ``queries`` has query_id, query and vector."""
    return fuse_methods(keyword_search(queries, docs, id_col, text_col, candidates), vector_search(queries, docs, id_col, vector_col, candidates), top_k)


def lexical_logit(asked: Column, text: Column, scale: float = 8.0, shift: float = -4.0) -> Column:
    """Offline stand-in for a cross-encoder: share of the query's distinct terms that the text has, as a logit."""
    want, have = F.array_distinct(terms(asked)), terms(text)
    share = F.size(F.array_intersect(want, have)) / F.greatest(F.size(want), F.lit(1))
    return F.lit(scale) * share + F.lit(shift)


def rerank(hits: DataFrame, logit: Column, top_k: int = config.RERANK_TOP_K) -> DataFrame:
    """The best ``top_k`` hits per query by ``rerank_score`` (any Column, a pandas UDF for a model); ties in fused order.

    ``hits`` has query_id and rank; the score is computed after the cut to the hits, in batches of an Arrow UDF's size.
    """
    scored = hits.withColumn("rerank_score", logit)
    return ranked(scored.withColumnRenamed("rank", "fused_rank"), [F.desc("rerank_score"), F.asc("fused_rank")], top_k)
