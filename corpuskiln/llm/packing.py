"""Filling containers of fixed capacity with whole texts by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket bounds with the least padding
when a bucket's container holds as many texts as its longest length allows. Token-budget batches then form
inside each bucket, longest first; what a batch leaves open is filled with the longest texts of shorter
buckets that still fit. The histogram has as many bins as the capacity, so nothing else reaches the driver.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.tokens import DEFAULT_VOCABULARY, token_count
from corpuskiln.tables import written


def bucket_bounds(histogram: np.ndarray, buckets: int, steps: int = 4096) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding; ``histogram[n]`` texts have length n.
    For a capacity over ``steps``, bounds are chosen among as many even steps.

    A container of a bucket with upper bound u holds capacity // u texts, so the texts of the bucket take
    count / (capacity // u) containers, and the padding is what these leave unused.
    """
    capacity = len(histogram) - 1
    if capacity > steps:
        width = -(-capacity // steps)
        rounded = np.minimum(-(-np.arange(capacity + 1) // width) * width, capacity)
        histogram = np.bincount(rounded, weights=histogram, minlength=capacity + 1).astype(np.int64)
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    count = np.r_[0, np.cumsum(histogram[lengths], dtype=np.float64)]
    tokens = np.r_[0, np.cumsum(histogram[lengths] * lengths, dtype=np.float64)]
    n = len(lengths)
    per = capacity / (capacity // lengths)  # space of one text in a bucket with this upper bound
    best, last, back = np.r_[0.0, np.full(n, np.inf)], np.inf, []
    for _ in range(min(buckets, n)):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + (count[j] - count[:j]) * per[j - 1] - (tokens[j] - tokens[:j])
            arg[j] = int(np.argmin(cost))
            new[j] = cost[arg[j]]
        if new[n] >= last - 1e-9:
            break
        best, last = new, new[n]
        back.append(arg)
    bounds, j = [], n
    for arg in reversed(back):
        bounds.append(int(lengths[j - 1]))
        j = arg[j]
    return sorted(bounds)


def fill(lengths: np.ndarray, capacity: int, bounds: list[int]) -> np.ndarray:
    """Container number of each of the texts of one shard.

    The bucket of the longest waiting text, with upper bound u, gives a container its ``capacity // u`` longest texts;
    then come the longest texts of shorter buckets that fit, and then those of the own one.
    """
    order = np.argsort(-lengths, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order[::-1]:
        waiting.setdefault(int(lengths[i]), []).append(int(i))
    present = sorted(waiting)
    out = np.full(len(lengths), -1, dtype=np.int64)
    container = 0

    def take(at: int) -> tuple[int, int]:
        length = present[at]
        i = waiting[length].pop()
        if not waiting[length]:
            present.pop(at)
        return i, length

    lows = [0, *bounds[:-1]]
    while present:
        bucket = bisect.bisect_left(bounds, present[-1])
        low, batch = lows[bucket], capacity // bounds[bucket]
        free = capacity
        while free:
            at = bisect.bisect_right(present, free) - 1
            if at < 0:
                break
            if batch and present[-1] > low:
                at, batch = len(present) - 1, batch - 1  # the own bucket first
            elif present[at] > low:
                batch, at = 0, max(bisect.bisect_right(present, low) - 1, 0) if present[0] <= low else at
            i, length = take(at)
            out[i] = container
            free -= length
        container += 1
    return out


def filled_in_order(lengths: np.ndarray, capacity: int) -> int:
    """Containers that the same texts take by best fit, longest first, without buckets: for comparison."""
    return int(fill(lengths, capacity, [capacity]).max(initial=-1)) + 1


def _filler(capacity: int, bounds: list[int]):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("tokens").to_numpy()
        # an order that no run changes: by id and piece
        ids = pa.compute.sort_indices(table, sort_keys=[("id", "ascending"), ("piece", "ascending")]).to_numpy()
        number = np.empty(len(lengths), dtype=np.int64)
        number[ids] = fill(lengths[ids], capacity, bounds)
        used = np.bincount(number, weights=lengths).astype(np.int32)[number]
        return pa.table({n: table.column(n) for n in ("id", "piece", "first_token", "tokens", "shard")} | {"number": pa.array(number), "used": pa.array(used)})

    return run


def fill_containers(
    df: DataFrame,
    id_col: str,
    text_col: str,
    capacity: int,
    buckets: int = 16,
    shard_rows: int = 20000,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """(id, piece, first_token, tokens, container, used): where each text goes, and how full its container gets.

    A text within the capacity is one whole piece. A longer one is cut into pieces of exactly the capacity and a
    rest, which is placed like any text. Null and empty texts have no tokens and no container (null). Rows
    repeated under one id are placed once each. Containers are filled in shards of about ``shard_rows`` texts
    by a hash of the id; an empty table gives an empty result.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    sized = written(df.select(F.col(id_col).alias("id"), token_count(F.col(text_col), vocabulary).alias("tokens")), "sizes")
    parts = sized.filter("tokens > 0").select(
        "id",
        F.explode(F.sequence(F.lit(0), F.expr(f"(tokens - 1) div {capacity}").cast("int"))).alias("piece"),
        F.col("tokens").alias("all"),
    ).select(
        "id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"),
        F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity).cast("int").alias("tokens"),
    )
    counts = parts.groupBy("tokens").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts:
        histogram[r["tokens"]] = r["count"]
    shards = max(1, -(-int(histogram.sum()) // shard_rows))
    bounds = bucket_bounds(histogram, buckets)
    kind = dict(sized.dtypes)["id"]
    placed = (
        parts.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_filler(capacity, bounds), f"id {kind}, piece int, first_token long, tokens int, shard long, number long, used int")
        .withColumn("container", F.concat_ws("-", "shard", "number"))
    )
    none = sized.filter("tokens = 0").select(
        "id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "tokens",
        F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("used"),
    )
    return placed.select("id", "piece", "first_token", "tokens", "container", "used").unionByName(none)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: texts, containers, tokens, and the share of all space that is used (null without containers)."""
    each = placed.filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    return each.agg(
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        F.count("*").alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        (F.sum("used") / (F.count("*") * F.lit(capacity))).alias("filled"),
        F.max("used").alias("fullest"),
    )
