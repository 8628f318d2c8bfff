"""Token counts under a public byte-level BPE, read from a vocabulary file on every executor."""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the word pattern that the vocabulary was made with
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and empty ones. The whole text counts, however long."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(vocabulary).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], type=pa.int32())

    return count(text)
