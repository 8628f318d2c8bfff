"""Column expressions on vectors kept as arrays; sums run in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskiln.functions.text import terms


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, has another length or is all zero."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """The vector at length one; as it is if all zero."""
    return let(F.struct(a.alias("v"), norm(a).alias("n")), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["n"])).otherwise(F.transform(s["v"], lambda x: x.cast("double"))))


def hashed_terms(text: Column, dims: int) -> Column:
    """Offline stand-in for a text encoder: counts of terms in ``dims`` buckets by their MD5, at length one.

    Null and empty texts give a vector of zeros. Terms are cut in the JVM and counted in Arrow batches.
    """

    @F.arrow_udf("array<double>")
    def count(column: pa.Array) -> pa.Array:
        flat = column.flatten().dictionary_encode()
        buckets = np.array([int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % dims for t in flat.dictionary.to_pylist()], dtype=np.int64)
        row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        each = np.zeros((len(column), dims))
        if len(row):
            np.add.at(each, (row, buckets[flat.indices.to_numpy(zero_copy_only=False)]), 1.0)
        length = np.linalg.norm(each, axis=1, keepdims=True)
        each = np.divide(each, length, out=each, where=length > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * dims), pa.array(each.reshape(-1)))

    return count(terms(F.coalesce(text, F.lit(""))))
