"""Splitting documents into chunks: fixed windows of terms, and recursive packing of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions.text import chunk_id, strip

SEPARATORS = ("\n\n", "\n", ". ", " ")
_TOKEN = re.compile(r"\s*\S+|\s+\Z")


def plain_tokens(text: str) -> list[str]:
    """Lossless offline tokens: each word with the white space before it; joined they give the text."""
    return _TOKEN.findall(text)


def fixed_windows(df: DataFrame, id_col: str, text_col: str, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """(parent_doc_id, chunk_index, chunk_id, text): windows of ``size`` words, a new one every ``size - overlap``.

    Words are separated by white space and joined by single spaces. Texts without words and null ones give no chunk.
    """
    check(size, overlap)
    step = size - overlap
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    return (
        df.select(F.col(id_col).cast("string").alias("parent_doc_id"), words.alias("words"))
        .filter(F.size("words") > 0)
        .withColumn("last", F.floor(F.greatest(F.size("words") - F.lit(overlap) - 1, F.lit(0)) / step).cast("int"))
        .select("parent_doc_id", "words", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk_index"))
        .select(
            "parent_doc_id",
            "chunk_index",
            chunk_id(F.col("parent_doc_id"), F.col("chunk_index")).alias("chunk_id"),
            F.array_join(F.slice("words", F.col("chunk_index") * step + 1, size), " ").alias("text"),
        )
    )


def check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be from 0 to less than the chunk size")


def _parts(text: str, size: int, encode: Callable[[str], list], level: int = 0) -> Iterator[list]:
    """Tokens of the parts of a text within the size: apart at the first separator, parts still over it at the next,
    at last at any token; separators are dropped."""
    tokens = encode(text)
    if len(tokens) <= size:
        yield tokens
    elif level == len(SEPARATORS):
        yield from (tokens[i : i + size] for i in range(0, len(tokens), size))
    else:
        for part in filter(None, text.split(SEPARATORS[level])):
            yield from _parts(part, size, encode, level + 1)


def pack_windows(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows (start, end) over the tokens of parts of these lengths, laid end to end.

    A window ends after the last whole part that fits. The next begins ``overlap`` tokens before that end, or at the
    window's own start if it is shorter, and takes what fits of the part that did not.
    """
    out, start, end, done = [], 0, 0, 0
    for length in lengths:
        done += length
        while end < done:
            if done - start <= size:
                end = done
            else:
                out.append((start, end))
                start = max(start, end - overlap)
                end = min(done, start + size)
    return [*out, (start, end)]


def recursive_pieces(text: str, size: int, overlap: int, encode: Callable[[str], list], decode: Callable[[list], str]) -> list[str]:
    """Chunks of at most ``size`` tokens, each but the first led by up to ``overlap`` tokens of the one before."""
    if len(encode(text)) <= size:
        return [text] if text.strip() else []
    parts = list(_parts(text, size, encode))
    tokens = [t for part in parts for t in part]
    texts = [decode(tokens[a:b]) for a, b in pack_windows([len(p) for p in parts], size, overlap)]
    return [t for t in texts if t.strip()]


def recursive_chunks(
    docs: DataFrame,
    size: int = config.CHUNK_SIZE,
    overlap: int = config.CHUNK_OVERLAP,
    tokenizer: Callable[[], tuple[Callable, Callable]] | None = None,
) -> DataFrame:
    """(chunk_id, parent_doc_id, chunk_index, text, metadata) of documents (doc_id, content, metadata).

    ``tokenizer`` is called once per worker and gives (encode, decode); by default tokens are words with the white
    space before them. Documents without text give no chunk. The index is dense from 0, blank chunks left out.
    """
    check(size, overlap)

    @F.arrow_udf("array<string>")
    def pieces(column: pa.Array) -> pa.Array:
        encode, decode = tokenizer() if tokenizer else (plain_tokens, "".join)
        return pa.array([recursive_pieces(t, size, overlap, encode, decode) if t else [] for t in column.to_pylist()], type=pa.list_(pa.string()))

    return docs.select("doc_id", "metadata", F.posexplode(pieces("content")).alias("chunk_index", "text")).select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").alias("parent_doc_id"), "chunk_index", "text", "metadata"
    )


def longest_chunks(chunks: DataFrame) -> DataFrame:
    """The longest chunk of every document; the first of equally long ones."""
    best = F.max_by(F.struct("chunk_id", "chunk_index", "text"), F.struct(F.length("text").alias("n"), (-F.col("chunk_index")).alias("first"))).alias("best")
    return chunks.filter(strip(F.col("text")) != "").groupBy("parent_doc_id").agg(best).select("parent_doc_id", "best.*")
