import json
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.operators import chunking, confidence, retrieval, store
from corpuskiln.operators.sampling import hash_sample
from corpuskiln.plans import answering, evaluation


def ranks(spark, *lists):
    return spark.createDataFrame([("q", i, n) for ids in lists for n, i in enumerate(ids, 1)], "query_id string, id string, rank int")


def test_rank_fusion(spark):
    got = {r["id"]: r["rrf_score"] for r in retrieval.fuse_ranks(ranks(spark, "abc", "bda")).collect()}
    assert got == pytest.approx({"b": 1 / 62 + 1 / 61, "a": 1 / 61 + 1 / 63, "d": 1 / 62, "c": 1 / 63})
    assert sorted(got, key=got.get, reverse=True) == ["b", "a", "d", "c"]
    assert {r["id"]: r["rrf_score"] for r in retrieval.fuse_ranks(ranks(spark, "ab"), 10).collect()} == pytest.approx({"a": 1 / 11, "b": 1 / 12})
    assert retrieval.fuse_ranks(ranks(spark, "a").limit(0)).count() == 0


def test_fusion_of_methods(spark):
    fused = retrieval.fuse_methods(ranks(spark, ["k1", "k2"]), ranks(spark, ["k2", "k3"])).orderBy("rank").collect()
    assert [r["id"] for r in fused] == ["k2", "k1", "k3"]
    assert [r["retrieved_by"] for r in fused] == [["keyword", "vector"], ["keyword"], ["vector"]]
    fused = retrieval.fuse_methods(ranks(spark, ["", "k"]), ranks(spark, ["v"])).orderBy("rank").collect()
    assert [r["id"] for r in fused] == ["v", "k"]


def test_keyword_search(spark):
    docs = spark.createDataFrame([("a", "heap heap tree"), ("b", "tree"), ("c", None), ("d", "other words here")], "id string, text string")
    queries = spark.createDataFrame([(1, "Heap, tree!"), (2, "nothing"), (3, None)], "query_id int, query string")
    got = [(r["query_id"], r["id"], r["rank"]) for r in retrieval.keyword_search(queries, docs, "id").orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", 1), (1, "b", 2)]
    assert retrieval.keyword_search(queries, docs.limit(0), "id").count() == 0


def test_vector_search_skips_unusable(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0])], "id string, embedding array<double>")
    got = retrieval.vector_search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>"), docs, "id").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 1.0), ("b", 1.0)]


def test_gate(spark):
    rows = [("q", "A", ["keyword", "vector"], 0.0, "wiki_1", 1), ("q", "B", ["keyword"], -5.0, "x", 2), ("q", "C", None, None, None, 3), ("q", "D", ["keyword", "vector"], -1000.0, "wiki_2", 4), ("q", "E", ["vector", "keyword"], 5.0, "x", 5)]
    df = spark.createDataFrame(rows, "query_id string, id string, retrieved_by array<string>, rerank_score double, source string, rank int")
    scored = confidence.with_confidence(df, F.lit("2024-01-01").cast("timestamp"))
    passed = confidence.gate(scored).orderBy("position").collect()
    assert [r["id"] for r in passed] == ["E", "A", "D"]
    assert {r["id"]: r["confidence_score"] for r in scored.collect()}["C"] == pytest.approx(0.35)


def test_source_lookup_keeps_a_given_source(spark):
    docs = spark.createDataFrame([("p", ("wiki_1",))], "doc_id string, metadata struct<source_file:string>")
    hits = spark.createDataFrame([("a", "p", ""), ("b", "p", "own"), ("c", "z", None)], "id string, parent_doc_id string, source string")
    assert {r["id"]: r["source"] for r in confidence.with_source(hits, docs).collect()} == {"a": "wiki_1", "b": "own", "c": None}


def test_context_and_refusal(spark):
    chunks = spark.createDataFrame([("q", 2, "b", "p", "s", "second"), ("q", 1, "a", "p", "s", "first"), ("q", 3, "c", "p", "s", "third")], "query_id string, position int, id string, parent_doc_id string, source string, text string")
    assert answering.context_blocks(chunks).first()["context"] == "[1] first\n[2] second\n[3] third"
    empty = answering.generate(spark.createDataFrame([("q", None)], "query_id string, prompt string")).first()
    assert empty["answer"] == config.EMPTY_CONTEXT_ANSWER and empty["usage"] is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(2, 20), st.data())
def test_recursive_pieces_stay_within_size(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    pieces = chunking.recursive_pieces(text, size, overlap, list, "".join)
    assert all(0 < len(p) <= size and p.strip() for p in pieces)
    assert bool(pieces) == bool(text.strip(". \n")) or not text.strip() or pieces or set(text) <= set(". \n")


def test_recursive_chunks(spark):
    docs = spark.createDataFrame([("d", "word " * 3000, None), ("e", "", None), ("f", None, None)], "doc_id string, content string, metadata struct<file_type:string>")
    got = chunking.recursive_chunks(docs, 100, 10).orderBy("chunk_index").collect()
    assert len(got) > 1 and [r["chunk_index"] for r in got] == list(range(len(got))) and {r["parent_doc_id"] for r in got} == {"d"}
    assert all(len(chunking.plain_tokens(r["text"])) <= 100 for r in got) and got[3]["chunk_id"] == "d:3"
    for size, overlap in ((0, 0), (5, -1), (5, 5)):
        with pytest.raises(ValueError):
            chunking.recursive_chunks(docs, size, overlap)


def test_store(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    chunks = spark.createDataFrame([("a:0", "a"), ("a:0", "a")], "chunk_id string, parent_doc_id string")
    assert [r[0] for r in store.orphans(docs, chunks).collect()] == ["b"]
    assert {r[0]: r[1] for r in store.chunk_counts(docs, chunks).collect()} == {"a": 1, "b": 0}
    cache = spark.createDataFrame([("k", "q", "old", "2024-01-01 10:00:00"), ("k", "q", "new", "2024-01-01 10:30:00"), ("l", "r", None, "2024-01-01 10:30:00")], "cache_key string, query string, result string, at string").withColumn("created_at", F.col("at").cast("timestamp")).drop("at")
    assert {r["cache_key"]: r["result"] for r in store.latest(cache, "cache_key", F.col("created_at")).collect()} == {"k": "new", "l": None}
    at = F.lit("2024-01-01 11:15:00").cast("timestamp")
    assert store.alive(cache, "created_at", at, config.CACHE_TTL).count() == 2
    assert store.alive(cache, "created_at", F.lit("2024-01-01 10:15:00").cast("timestamp"), config.CACHE_TTL).count() == 1


def test_sweeps(spark):
    best = spark.createDataFrame([("a", "genuine", 0.6), ("b", "genuine", 0.5), ("c", "adversarial", 0.45), ("d", "adversarial", None)], "query_id string, label string, best double")
    rows = {r["threshold"]: (r["genuine_passed"], r["adversarial_gated"]) for r in evaluation.threshold_sweep(best).collect()}
    assert rows[0.5] == (2, 2) and rows[0.4] == (2, 1) and rows[0.7] == (0, 2)
    one = evaluation.recommended_threshold(best).first()
    assert one["threshold"] == pytest.approx(0.49) and one["gated"] == 2 and one["accepted"] is False
    assert [r["query_id"] for r in evaluation.extremes(best, "adversarial", 6, True).collect()] == ["c", "d"]


def test_recall_and_rates(spark):
    hits = spark.createDataFrame([(1, "p", 2), (1, "q", 1), (2, "z", 1)], "query_id int, parent_doc_id string, rank int")
    targets = spark.createDataFrame([(1, "p"), (2, "y"), (3, "x")], "query_id int, source_doc_id string")
    assert {r["k"]: (r["hits"], r["entries"]) for r in evaluation.recall_at(hits, targets).collect()} == {1: (0, 3), 3: (1, 3), 5: (1, 3)}
    assert {r["recall"] for r in evaluation.recall_at(hits, targets.limit(0)).collect()} == {0.0}
    verdicts = spark.createDataFrame([("x", "NONE."), ("y", "claim"), (config.REFUSAL, "claim")], "answer string, verdict string")
    assert tuple(evaluation.unsupported_rate(verdicts).first()) == (2, 1, 0.5)
    assert evaluation.unsupported_rate(verdicts.limit(0)).first()["rate"] is None
    assert tuple(evaluation.gate_rate(verdicts).first()) == (3, 1, pytest.approx(1 / 3))


def test_hash_sample(spark):
    df = spark.range(1000)
    a, b = hash_sample(df, F.col("id"), 50), hash_sample(df.repartition(7), F.col("id"), 50)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 50
    assert hash_sample(df.limit(0), F.col("id"), 5).count() == 0


def packed_one_by_one(parts, size, overlap):
    """The packing written out token by token: a chunk closes before the part that does not fit."""
    out, chunk, waiting = [], [], [list(p) for p in parts]
    while waiting:
        part = waiting.pop(0)
        if len(chunk) + len(part) <= size:
            chunk += part
            continue
        out.append(chunk)
        chunk = chunk[-overlap:] if overlap else []
        room = size - len(chunk)
        chunk = chunk + part[:room]
        if part[room:]:
            waiting.insert(0, part[room:])
    return [*out, chunk]


@given(st.lists(st.integers(1, 12), min_size=1, max_size=30), st.integers(0, 11))
def test_packing_against_tokens(lengths, overlap):
    tokens = iter(range(sum(lengths)))
    parts = [[next(tokens) for _ in range(n)] for n in lengths]
    every = [t for p in parts for t in p]
    assert [every[a:b] for a, b in chunking.pack_windows(lengths, 12, overlap)] == packed_one_by_one(parts, 12, overlap)


def test_a_chunk_shorter_than_the_overlap_is_kept_whole():
    text = " ".join(["w"] * 30) + "\n\n" + " ".join(["v"] * 490)
    pieces = [chunking.plain_tokens(p) for p in chunking.recursive_pieces(text, 500, 50, lambda t: re.findall(r"\S", t), "".join)]
    assert [len(p) for p in map("".join, pieces)] == [30, 500, 70]


def test_vector_search_over_many_batches(spark):
    """The best of a task are kept over its batches, ties included."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(400).select("id", F.array(F.cos(F.col("id") % 90), F.sin(F.col("id") % 90)).alias("v"))
        queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id int, vector array<double>")
        got = [(r["query_id"], r["id"]) for r in retrieval.vector_search(queries, rows, "id", "v", 9).orderBy("query_id", "rank").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    angle = {1: lambda k: math.cos(k % 90), 2: lambda k: math.sin(k % 90)}
    assert got == [(q, k) for q in (1, 2) for k in sorted(range(400), key=lambda k: (-round(angle[q](k), 6), k))[:9]]


def test_searches_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k % 7} and word{k % 5}") for k in range(40)], "id int, text string")
    queries = spark.createDataFrame([(k, f"word{k}") for k in range(7)], "query_id int, query string")
    whole = sorted(map(tuple, retrieval.keyword_search(queries, docs, "id").collect()))
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 2)
    assert sorted(map(tuple, retrieval.keyword_search(queries, docs, "id").collect())) == whole and whole


def test_latest_of_few(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only"), (None, 1, "x"), (None, 2, "y"), ("c", None, "n"), ("c", 0, "z")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    got = {tuple(r) for r in store.latest_of_few(df, "k", F.col("at")).collect()}
    assert got == {tuple(r) for r in store.latest(df, "k", F.col("at")).collect()} == {("a", 2, "new"), ("b", 1, "only"), (None, 2, "y"), ("c", 0, "z")}
    assert store.latest_of_few(df.limit(0), "k", F.col("at")).count() == 0


def test_answers_are_traced_and_cached(spark):
    class Moody:
        """Fails on one question."""

        def complete(self, system, user):
            if "bad" in user:
                raise RuntimeError("no reply")
            return "It holds trees [1].", {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}

    chunks = spark.createDataFrame([("d:0", "d", "a heap holds good trees", [1.0, 0.0]), ("d:1", "d", "a list is bad", [0.0, 1.0])], "chunk_id string, parent_doc_id string, text string, embedding array<double>")
    docs = spark.createDataFrame([("d", ("raw/wiki_1.txt",))], "doc_id string, metadata struct<source_file:string>")
    queries = spark.createDataFrame([(1, "good trees", [1.0, 0.0]), (2, "bad list", [0.0, 1.0]), (3, "unknown", [0.0, 0.0]), (4, "old one", [0.0, 0.0])], "query_id int, query string, vector array<double>")
    cached = queries.select("query_id", F.expr("named_struct('answer', 'kept', 'citations', array(named_struct('marker', 1, 'chunk_id', 'x')), 'context_chunks', array(named_struct('chunk_id', 'x', 'text', 't')))").alias("result"), (F.col("query_id") == 4).alias("hit"))
    at = F.to_timestamp(F.lit("2024-01-01"))
    done = answering.answer_and_record(queries, chunks, docs, at, model=Moody, cached=cached)
    answers = {r["query_id"]: r for r in done.answers.collect()}
    assert answers[1]["answer"] == "It holds trees [1]." and answers[1]["citations"][0]["chunk_id"] == "d:0" and answers[1]["usage"]["total_tokens"] == 7
    assert answers[2]["answer"] is None and answers[2]["error"] == "no reply"
    assert answers[3]["answer"] == config.REFUSAL and answers[3]["context_chunks"] == [] and answers[4]["from_cache"] and answers[4]["answer"] == "kept"
    traces = {r["query"]: r for r in done.traces.collect()}
    stages = {q: json.loads(r["stages"]) for q, r in traces.items()}
    assert len(traces) == 4 and stages["old one"] == {"cache": {"hit": True}}
    assert list(stages["good trees"]) == ["cache", "retrieval", "rerank", "confidence", "generation", "citations"] and stages["good trees"]["generation"]["token_usage"]["total_tokens"] == 7
    assert [c["chunk_id"] for c in stages["good trees"]["retrieval"]["chunks"]] == ["d:0", "d:1"] and "text" not in traces["good trees"]["stages"]
    assert stages["unknown"]["generation"] == {"skipped": True, "reason": "insufficient_evidence"} and stages["unknown"]["citations"] == {"citations": []}
    assert traces["bad list"]["success"] is False and traces["bad list"]["error"] == "no reply" and "generation" not in stages["bad list"]
    assert {r["query"] for r in done.cache.collect()} == {"good trees", "unknown"}


def test_questions_and_judge(spark):
    class Judge:
        def complete(self, system, user):
            return ("none." if "trees" in user.partition("ANSWER")[2] else "It is bad.") if system == config.JUDGE_RULES else '"What holds trees?"', {}

    passages = spark.createDataFrame([(1, "a heap holds trees")], "query_id int, text string")
    assert [tuple(r) for r in answering.ask_questions(passages, Judge).collect()] == [(1, "What holds trees?")]
    answers = spark.createDataFrame([(1, "trees"), (2, "bad"), (3, config.REFUSAL)], "query_id int, answer string")
    contexts = spark.createDataFrame([(k, "c") for k in (1, 2, 3)], "query_id int, context string")
    rate = evaluation.unsupported_rate(answering.judge(answers, contexts, Judge)).first()
    assert (rate["judged"], rate["flagged"], rate["rate"]) == (2, 1, 0.5)


def test_dates_as_text(spark):
    df = spark.createDataFrame([("2999-01-01",), ("20150101",), ("soon",), (None,)], "date string").selectExpr("date", "null as source", "null as retrieved_by", "null as rerank_score")
    df = df.withColumns({"source": F.lit("x"), "retrieved_by": F.array(F.lit("keyword")), "rerank_score": F.lit(0.0)})
    from corpuskiln.operators import confidence

    got = [r["f"] for r in df.select(confidence.parts(F.to_timestamp(F.lit("2024-01-01")), df)["freshness"].alias("f")).collect()]
    assert got[0] == 1.0 and got[1] < 0.05 and got[2] == got[3] == 0.3


def test_context_for_a_judge(spark):
    chunks = spark.createDataFrame([("a", " one "), ("b", "\n")], "chunk_id string, text string")
    kind = "query_id int, citations array<struct<marker:int,chunk_id:string>>, context_chunks array<struct<chunk_id:string,text:string>>"
    rows = [(1, [(1, "a"), (2, "b")], []), (2, [], [("x", " t "), ("y", "")]), (3, [(1, "gone")], [("x", "t")]), (4, None, None)]
    got = {r["query_id"]: r["context"] for r in evaluation.judged_context(spark.createDataFrame(rows, kind), chunks).collect()}
    assert got == {1: "one", 2: "t", 3: config.NO_CHUNKS, 4: config.NO_CHUNKS}


def shuffled_rows(spark):
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_searches_move_the_best_only(spark):
    """200 queries that share words with all of 1,000 texts: what moves follows tasks, queries and the limit, not the pairs."""
    docs = spark.range(1000).selectExpr("printf('%04d', id) as id", "concat('heap tree ', repeat('list ', int(id % 7)), 'w', id % 200) as text", "array(1.0, id % 7) as embedding")
    queries = spark.range(200).selectExpr("id as query_id", "concat('the heap tree w', id) as query", "array(1.0, id % 5) as vector")
    before = shuffled_rows(spark)
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.keyword_search(queries, docs, "id", limit=3).collect()}
    assert len(got) == 600 and all(int(i) % 200 == q for (q, _), i in got.items())
    between = shuffled_rows(spark)
    assert retrieval.vector_search(queries, docs, "id", limit=3).count() == 600
    assert between - before < 20_000 and shuffled_rows(spark) - between < 120_000  # of 200,000 pairs; equal vectors tie
