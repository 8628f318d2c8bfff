"""Samples that do not depend on partitioning or on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: Column, rows: int, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows of ``df``: those with the least hash of ``key``; about as many for any size of ``df``.

    Rows are first thinned out by the hash, so that no task hands many more than its share to the final sort.
    Rows with equal keys are taken together or, at the limit, in no fixed order; an empty table gives none.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12)  # 52 bits
    share = min(1.0, 1.5 * rows / max(1, df.count()) + 1e-9)
    return df.withColumn("_place", place).filter(F.col("_place") <= int(share * 2**52)).orderBy("_place").limit(rows).drop("_place")
