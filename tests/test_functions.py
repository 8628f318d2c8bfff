import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions import scores, text, vectors
from corpuskiln.plans.answering import Extractive, RateLimited, map_citations, wait_of, with_retries


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_doc_id_reads_bytes_as_latin1(spark):
    raw = bytes([0x68, 0xFF, 0x69, 0xC3, 0xA9])
    want = hashlib.sha256(b"a/b.txt" + b"::" + raw.decode("latin-1").encode("utf-8")).hexdigest()
    got = spark.createDataFrame([("a/b.txt", bytearray(raw))], "p string, c binary").select(text.doc_id(F.col("p"), F.col("c"))).first()[0]
    assert got == want


@pytest.mark.parametrize(("answer", "want"), [
    (config.REFUSAL, True), ("  insufficient  EVIDENCE found to\nanswer this question. ", True), ("Insufficient evidence", False), ("", False), (None, False),
])
def test_refusal(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "a string").select(text.is_refusal(F.col("a"))).first()[0] is want


@pytest.mark.parametrize(("answer", "want"), [
    ("A says [1]. B says [2] and [1].", [1, 2]), ("x 【1†L1-L3】 y [12abc]", [1, 12]), ("none", []), (None, []), ("[99999999999]", []), ("[0][2", [0]),
])
def test_citation_markers(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "a string").select(text.citation_markers(F.col("a"))).first()[0] == want


def test_citations_out_of_range_are_dropped(spark):
    df = spark.createDataFrame([("Real [2] but bogus [5] and [0].", [("a", "p", "s"), ("b", "p", None), ("c", "q", None)])], "answer string, c array<struct<id:string,parent_doc_id:string,source:string>>")
    got = df.select(map_citations(F.col("answer"), F.col("c")).alias("x")).first()["x"]
    assert [tuple(r) for r in got] == [(2, "b", "p", None)]


def test_scores_by_hand(spark):
    now = F.to_timestamp(F.lit("2024-01-01"))
    stamp = lambda s: scores.freshness(scores.as_time(F.lit(s).cast("string")), now)
    assert one(spark, stamp(None)) == 0.3
    assert one(spark, stamp("not a date")) == 0.3
    assert one(spark, stamp("2999-01-01")) == 1.0
    assert one(spark, stamp("20150101")) < 0.05
    assert one(spark, stamp("2023-01-01T00:00:00+00:00")) == pytest.approx(math.exp(-1), abs=1e-9)
    for x, want in ((0.0, 0.5), (-1000.0, 0.0), (1000.0, 1.0)):
        assert one(spark, scores.relevance(F.lit(x))) == want
    assert one(spark, scores.relevance(F.lit(None).cast("double"))) == 0.5
    assert one(spark, scores.trust(F.lit("data/raw/wiki_1.txt"))) == 0.8
    assert one(spark, scores.trust(F.lit(None).cast("string"))) == 0.6
    assert one(spark, scores.overlap(F.lit(None).cast("array<string>"))) == 0.0
    parts = {"freshness": F.lit(0.3), "trust": F.lit(0.6), "overlap": F.lit(1.0), "relevance": F.lit(0.5)}
    assert one(spark, scores.weighted(parts)) == pytest.approx(0.6)
    assert one(spark, scores.weighted(parts | {"overlap": F.lit(0.0)}, {})) == pytest.approx(0.35)
    assert one(spark, scores.weighted({"trust": F.lit(9.0)}, {"trust": 1.0})) == 1.0


def test_page_text(spark):
    page = "<!DOCTYPE html><html><head><title> A &amp; B </title><style>p{}</style></head><body><script>if (a<b) x()</script><p> one <b>two</b></p><!-- no --><p>3 &lt; 4</p></body></html>"
    row = spark.createDataFrame([(page,)], "h string").select(text.html_text(F.col("h")), text.html_title(F.col("h"))).first()
    assert row[0] == "A & B\none\ntwo\n3 < 4" and row[1] == "A & B"


def test_markdown_text(spark):
    source = "# Head #\n\nSome `code` and **bold** [link](http://x).\n\n```py\nx = 1\n```\n- item\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    got = spark.createDataFrame([(source,)], "m string").select(text.markdown_text(F.col("m"))).first()[0]
    assert "code" not in got and "x = 1" not in got and "#" not in got and "**" not in got
    assert {"Head", "bold", "link", "item"} <= set(got.replace("\n", " ").split())


def test_small_text_functions(spark):
    assert one(spark, text.title_of(F.lit(" TITLE:  Heap sort \nbody"))) == "Heap sort"
    assert one(spark, text.title_of(F.lit("no title\nTitle: x"))) == ""
    assert one(spark, text.clean_question(F.lit(' " Why? " '))) == "Why?"
    assert one(spark, text.verdict_is_none(F.lit(" None.\n"))) is True
    assert one(spark, text.verdict_is_none(F.lit("claim"))) is False
    assert one(spark, text.file_type(F.lit("a/b.HTM"))) == "html"
    assert one(spark, text.file_type(F.lit("a/b.xyz"))) is None
    assert one(spark, text.cache_key(F.lit("\t Hello \n"))) == hashlib.sha256(b"hello").hexdigest()
    assert one(spark, text.title_matches(F.lit("History of COMPILERS"))) is True
    assert one(spark, text.title_matches(F.lit("Apiary"))) is False
    assert one(spark, text.terms(F.lit("Über-Größe, 42!"))) == ["über", "größe", "42"]


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(1, 0), v(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine(v(0, 0), v(1, 1))) is None
    assert one(spark, vectors.cosine(v(1), v(1, 1))) is None
    assert one(spark, vectors.unit(v(3, 4))) == [0.6, 0.8]
    assert one(spark, vectors.unit(v(0, 0))) == [0.0, 0.0]
    rows = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(vectors.hashed_terms(F.col("t"), 8).alias("v")).collect()
    assert sum(x * x for x in rows[0]["v"]) == pytest.approx(1) and rows[1]["v"] == rows[2]["v"] == [0.0] * 8


def test_waiting_and_retries():
    assert wait_of({"retry-after-ms": "1500", "retry-after": "9"}) == 1.5
    assert wait_of({"retry-after": "500"}) == 60.0 and wait_of({"retry-after": "-1"}) == 0.0
    assert wait_of({"retry-after": "soon"}) is None and wait_of({}) is None
    slept, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RateLimited(None if len(calls) == 1 else 0)
        return "ok", {}

    assert with_retries(call, sleep=slept.append)[0] == "ok" and slept == [1.0, 2.0]
    with pytest.raises(RateLimited):
        with_retries(lambda: (_ for _ in ()).throw(RateLimited(1)), sleep=lambda s: None)
    with pytest.raises(ValueError):
        with_retries(lambda: (_ for _ in ()).throw(ValueError()), sleep=lambda s: None)


def test_extractive_model():
    reply, usage = Extractive().complete("", "Context:\n[1] First one. More.\n[2] x\n\nQuestion: q")
    assert reply == "First one. [1]" and usage["total_tokens"] == usage["prompt_tokens"] + usage["completion_tokens"]


def test_entities(spark):
    page = "<p>caf&eacute; &#8217;x&#x27; a&nbsp;b &mdash; 5 &euro; &amp;lt; &copy 2 AT&T &unknown; &lt;b&gt;</p>"
    assert one(spark, text.html_text(F.lit(page))) == "café ’x' a\xa0b — 5 € &lt; © 2 AT&T &unknown; <b>"
    assert one(spark, text.snippet(F.lit("x" * 200))) == "x" * 180
