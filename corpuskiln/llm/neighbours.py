"""Most similar vectors for every vector, by cross-polytope hashing.

A vector is rotated by three rounds of random sign flips and fast Hadamard transforms and goes to the
bucket of its nearest signed axis. The number of buckets follows the number of vectors, so a bucket keeps
about ``bucket_rows`` members at every size. Each vector is a member of one bucket per table and a query
in that bucket and in the ``probes`` next best ones; members of a bucket are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.tables import written

#: rows of a table of (bucket, blocks) that may be broadcast: 12 MB
MOST_BROADCAST = 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` hash functions, each a chain of cross-polytope hashes with at least ``buckets`` cells in all."""

    def __init__(self, dims: int, tables: int, buckets: int, seed: int = 7):
        self.dims, self.padded = dims, 1 << max(1, (dims - 1).bit_length())
        sizes, left = [], max(2, buckets)
        while left > 1:
            axes = min(self.padded, 1 << max(0, int(np.ceil(np.log2(left))) - 1))
            sizes.append(axes)
            left = left / (2 * axes)
        self.axes, self.tables = sizes, tables
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), size=(tables, len(sizes), 3, self.padded))

    def probes(self, x: np.ndarray, extra: int) -> np.ndarray:
        """(rows, tables, 1 + extra) bucket numbers, the vector's own bucket first."""
        n = len(x)
        padded = np.zeros((n, self.padded), dtype=np.float32)
        padded[:, : self.dims] = x
        out = np.empty((n, self.tables, 1 + extra), dtype=np.int64)
        for t in range(self.tables):
            loss, code = np.zeros((n, 1), dtype=np.float32), np.zeros((n, 1), dtype=np.int64)
            for k, axes in enumerate(self.axes):
                y = padded
                for s in self.signs[t, k]:
                    y = hadamard(y * s)
                y = y[:, :axes]
                both = np.concatenate((y, -y), axis=1)
                keep = min(1 + extra, both.shape[1])
                best = np.argsort(-both, axis=1, kind="stable")[:, :keep]
                value = np.take_along_axis(both, best, axis=1)
                loss = (loss[:, :, None] + (value[:, :1] - value)[:, None, :]).reshape(n, -1)
                code = (code[:, :, None] * (2 * axes) + best[:, None, :]).reshape(n, -1)
                order = np.argsort(loss, axis=1, kind="stable")[:, : 1 + extra]
                loss, code = np.take_along_axis(loss, order, axis=1), np.take_along_axis(code, order, axis=1)
            if code.shape[1] < 1 + extra:  # fewer cells than probes: repeat the own bucket, dropped by the caller
                code = np.concatenate((code, np.repeat(code[:, :1], 1 + extra - code.shape[1], axis=1)), axis=1)
            out[:, t] = code
        return out

    @property
    def cells(self) -> int:
        return int(np.prod([2 * a for a in self.axes], dtype=np.int64))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """Distinct (id, vec) with exactly ``dims`` finite values that are not all zero."""
    v = F.col("vec")
    return (
        df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("vec"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) == dims))
        .filter(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0))
        .groupBy("id")
        .agg(F.min("vec").alias("vec"))
    )


def _placed(reps: DataFrame, hashing: CrossPolytope, extra: int, dims: int, sizes: bool = False) -> DataFrame:
    """(bucket, key, vec, member): each vector in its own bucket of each table and, as a query, in the next ones. With
    ``sizes`` (bucket, rows): how many these are, added up in each task."""
    cells = hashing.cells

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), dims).astype(np.float32)
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            code = hashing.probes((x / norm[:, None]).astype(np.float32), extra)
            code += (np.arange(hashing.tables, dtype=np.int64) * cells)[None, :, None]
            n, t, p = code.shape
            row = np.repeat(np.arange(n), t * p)
            first = np.tile(np.arange(p) == 0, n * t)
            fresh = first | (code != code[:, :, :1]).reshape(-1)
            row, member, bucket = row[fresh], first[fresh], code.reshape(-1)[fresh]
            if sizes:
                each, n = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n)], names=["bucket", "rows"])
                continue
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), batch.column("key").take(take), batch.column("vec").take(take), pa.array(member)],
                names=["bucket", "key", "vec", "member"],
            )

    if sizes:
        return reps.select("key", "vec").mapInArrow(place, "bucket long, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows"))
    return reps.select("key", "vec").mapInArrow(place, "bucket long, key long, vec array<float>, member boolean")


def _compare(dims: int, keep: int):
    """Best ``keep`` members for every query of one block of one bucket."""
    schema = pa.schema([("key", pa.int64()), ("cand", pa.list_(pa.int64())), ("sim", pa.list_(pa.float64()))])

    def compare(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        member, query = table.column("member").to_numpy(), table.column("query").to_numpy()
        x = _matrix(table.column("vec"), dims).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        mk, mx = key[member], x[member]
        qk, qx = key[query], x[query]
        if not len(mk) or not len(qk):
            return schema.empty_table()
        keys, cands, sims = [], [], []
        k = min(keep, len(mk))
        for a in range(0, len(qk), 1024):
            s = qx[a : a + 1024] @ mx.T
            s[qk[a : a + 1024, None] == mk[None, :]] = -np.inf
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            keys.append(qk[a : a + 1024])
            cands.append(mk[top])
            sims.append(np.take_along_axis(s, top, axis=1))
        n = sum(map(len, keys))
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * k)
        return pa.table(
            [
                pa.array(np.concatenate(keys)),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(cands).reshape(-1))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sims).reshape(-1))),
            ],
            schema=schema,
        )

    return compare


def _merge(keep: int):
    """Best ``keep`` candidates per query over all its buckets."""

    def merge(table: pa.Table) -> pa.Table:
        cand = table.column("cand").combine_chunks()
        key = np.repeat(table.column("key").to_numpy(), cand.value_lengths().to_numpy())
        c, s = cand.flatten().to_numpy(), table.column("sim").combine_chunks().flatten().to_numpy()
        ok = np.isfinite(s)
        key, c, s = key[ok], c[ok], s[ok]
        order = np.lexsort((-s, c, key))
        key, c, s = key[order], c[order], s[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
        key, c, s = key[fresh], c[fresh], s[fresh]
        order = np.lexsort((c, -s, key))
        key, c, s = key[order], c[order], s[order]
        start = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1] if len(key) else np.zeros(0, dtype=int)
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
        good = rank < keep
        return pa.table({"key": key[good], "near": c[good], "sim": s[good]})

    return merge


def nearest_vectors(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 5,
    dims: int = 64,
    tables: int = 4,
    probes: int = 1,
    bucket_rows: int = 1500,
    hot_rows: int = 8192,
    seed: int = 7,
) -> DataFrame:
    """(id, neighbour, similarity, rank): the ``k`` most similar other ids of every id, by cosine in double precision.

    Rows whose vector is null, of another length, all zero or not finite take no part; rows repeated under one
    id count once (the least vector, should they differ). Ids with equal vectors form one class that is compared
    once; its members find each other. Ties go to the smaller id, exactly so among ids with equal vectors and
    among the ``k + 2`` best others. An empty table gives an empty result; other columns of ``df`` are ignored.
    A bucket of more than ``hot_rows`` rows is compared in blocks, each query with every block, so that no task
    holds it whole and nothing is left out.
    """
    members = written(
        usable_vectors(df, id_col, vector_col, dims).withColumn("key", F.xxhash64("vec")), "vectors"
    )
    reps = members.groupBy("key").agg(F.min("vec").alias("vec"))
    count = reps.count()
    hashing = CrossPolytope(dims, tables, max(2, count // bucket_rows), seed)
    placed = _placed(reps, hashing, probes, dims)

    # Buckets over the limit, at most one for so many rows: their sizes go to all tasks if they are few enough.
    hot = written(_placed(reps, hashing, probes, dims, sizes=True).filter(F.col("rows") > hot_rows).select("bucket", F.ceil(F.col("rows") / hot_rows).cast("int").alias("blocks")), "hot")
    few = hot.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    placed = placed.join(F.broadcast(hot) if few else hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # a query meets every block of members, a member every block of queries
    pairs = F.expr(
        """array_union(transform(sequence(0, blocks - 1), m -> own * blocks + m),
        if(member, transform(sequence(0, blocks - 1), q -> q * blocks + own), array()))"""
    )
    placed = (
        placed.withColumn("own", own)
        .withColumn("block", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(pairs)))
        .select(
            "bucket", "block", "key", "vec",
            (F.col("member") & (F.col("block") % F.col("blocks") == F.col("own"))).alias("member"),
            (F.floor(F.col("block") / F.col("blocks")) == F.col("own")).alias("query"),
        )
    )
    keep = k + 2
    near = placed.groupBy("bucket", "block").applyInArrow(_compare(dims, keep), "key long, cand array<long>, sim array<double>")
    groups = 1 + count // 4000
    near = near.groupBy(F.pmod(F.col("key"), F.lit(groups)).alias("part")).applyInArrow(_merge(keep), "key long, near long, sim double")

    # The k + 1 smallest ids of each class stand for it; a class is found by its key.
    spelled = (
        members.select("key", "id")
        .withColumn("n", F.row_number().over(_by("key", "id")))
        .filter(F.col("n") <= k + 1)
        .drop("n")
    )
    own = members.groupBy("key").count().filter("count > 1").select("key", F.col("key").alias("near"), F.lit(1.0).alias("sim"))
    found = (
        near.unionByName(own)
        .join(spelled.withColumnRenamed("key", "near"), "near")
        .groupBy("key")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("id").alias("neighbour")))), 1, k + 1).alias("best"))
    )
    return (
        members.select("key", "id")
        .join(found, "key")
        .select("id", F.posexplode(F.slice(F.filter("best", lambda b: b["neighbour"] != F.col("id")), 1, k)).alias("rank", "b"))
        .select("id", F.col("b.neighbour").alias("neighbour"), (-F.col("b.far")).alias("similarity"), (F.col("rank") + 1).alias("rank"))
    )


def _by(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


def similar_pairs(near: DataFrame) -> DataFrame:
    """Distinct unordered pairs (chunk_id_a < chunk_id_b) of which at least one finds the other."""
    return near.select(
        F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")
    ).distinct()
