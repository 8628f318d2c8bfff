import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskiln.llm import split
from corpuskiln.llm.split import SIZE_PATTERN, size_of, split_oversized, split_text

SIZE = re.compile(SIZE_PATTERN)


def size(text):
    return sum(1 for _ in SIZE.finditer(text))


PART = st.sampled_from(["a", "bb ", " ", "\n", "\n\n", "。", ". ", "# H\n", "x" * 30, "日本", "- i\n", "\t", "\r\n", "Title\n", "<p>", "😀" * 9])


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=150).map("".join), st.integers(2, 40), st.data())
def test_pieces_tile_the_text_and_fit(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = split_text(text, limit, overlap)
    assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
    assert all(size(text[s:j]) <= limit for s, _, j in pieces)
    assert (len(pieces) > 1) == (size(text) > limit)


def test_cuts_are_natural_and_overlap_is_exact():
    section = "## Part {}\n\n" + "One sentence of some words here. " * 12 + "\n\n- item one\n- item two\n\n"
    text = "".join(section.format(k) for k in range(12))
    pieces = split_text(text, 200, 20)
    assert len(pieces) > 3
    assert all(size(text[s:i]) == 20 for s, i, _ in pieces[1:])
    assert all(text[i:].lstrip().startswith("## Part") for _, i, _ in pieces[1:])


def test_long_words_are_cut():
    pieces = split_text("x" * 8000, 100, 10)
    assert [j - s <= 800 for s, _, j in pieces] == [True] * len(pieces)


def test_operator(spark):
    rows = [("a", "short", 1), ("b", "word " * 300, 2), ("b", "word " * 300, 2), ("c", "", 3), ("d", None, 4), (None, "word " * 300, 5)]
    df = spark.createDataFrame(rows, "id string, text string, piece int")
    out = split_oversized(df, "text", 100, 10)
    assert out.columns == ["id", "text", "piece"]
    got = out.select("id", "piece.*").collect()
    assert [(r["chunk_index"], r["text"], r["size"]) for r in got if r["id"] == "a"] == [(0, "short", 1)]
    assert [r["text"] for r in got if r["id"] == "c"] == [""] and [r["text"] for r in got if r["id"] == "d"] == [None]
    b = sorted(r["chunk_index"] for r in got if r["id"] == "b")
    assert b == sorted([*range(len(b) // 2)] * 2) and len(b) >= 8
    assert out.limit(0).count() == 0 and split_oversized(df.limit(0), "text", 100).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "text", 10, 10)


def test_size_in_the_jvm(spark):
    texts = ["", "a", "a" * 17, " \n a b ", "日本語" * 5, "😀" * 9, "a b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(size_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [size(t) for t in texts]


def test_overlaps_begin_at_words():
    text = "\n\n".join(" ".join(f"considerable{k}words" for k in range(n, n + 40)) + "." for n in range(0, 400, 40))
    pieces = split.split_cuts(text, 100, 10)
    assert len(pieces) > 5
    for start, begin, _, cut in pieces[1:]:
        assert text[start] in " \n" and size(text[start:begin]) >= 10 and cut in ("paragraph", "sentence", "word", "line")


def test_cut_names(spark):
    text = "Title\n" + "A sentence of some words here. " * 40 + "\n\n" + "x" * 3000
    df = spark.createDataFrame([(text,), ("short",), (None,)], "text string")
    rows = split.split_oversized(df, "text", 50, 5).select("piece.*").collect()
    cuts = [r["cut"] for r in rows]
    assert cuts.count("start") == 3 and "sentence" in cuts and "inside a word" in cuts
