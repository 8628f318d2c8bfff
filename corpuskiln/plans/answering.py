"""From queries to cited answers, for a whole set of queries at once."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions.text import cache_key, citation_markers, clean_question, is_refusal
from corpuskiln.operators import confidence, retrieval
from corpuskiln.operators.sampling import hash_sample
from corpuskiln.plans import evaluation
from corpuskiln.tables import written


class LanguageModel(Protocol):
    """What a model client must offer; made once per task by the factory given to ``generate``."""

    def complete(self, system: str, user: str) -> tuple[str, dict[str, int]]: ...


class RateLimited(Exception):
    """Raised by a client that is asked to wait; ``seconds`` is None if it was not told how long."""

    def __init__(self, seconds: float | None = None):
        super().__init__(f"rate limited, retry after {seconds}")
        self.seconds = seconds


def wait_of(headers: dict[str, str]) -> float | None:
    """Seconds to wait from a reply's headers, milliseconds first, within 0 and 60; None if absent or unreadable."""
    for name, scale in (("retry-after-ms", 1000.0), ("retry-after", 1.0)):
        if name in headers:
            try:
                return min(60.0, max(0.0, float(headers[name]) / scale))
            except (TypeError, ValueError):
                continue
    return None


def with_retries(call: Callable[[], tuple[str, dict[str, int]]], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[str, dict[str, int]]:
    """Calls again after RateLimited, at most ``attempts`` times in all; waits 1 s, then 2 s where not told (or told 0)."""
    for k in range(attempts):
        try:
            return call()
        except RateLimited as e:
            if k + 1 == attempts:
                raise
            sleep(e.seconds or float(2**k))
    raise AssertionError


class Extractive:
    """Offline stand-in for a language model: the first sentence of the first context chunk, cited."""

    def complete(self, system: str, user: str) -> tuple[str, dict[str, int]]:
        context = user.partition("Context:\n")[2].rpartition("\n\nQuestion: ")[0]
        first = context.partition("\n[2] ")[0].removeprefix("[1] ").strip()
        sentence = first.split("\n")[0].partition(". ")[0].rstrip(".")
        words = {"prompt_tokens": len((system + " " + user).split()), "completion_tokens": len(sentence.split()) + 1}
        return f"{sentence}. [1]", words | {"total_tokens": sum(words.values())}


class NumberJudge:
    """Offline stand-in for a judge: an answer is supported if the context has all its numbers but markers."""

    def complete(self, system: str, user: str) -> tuple[str, dict[str, int]]:
        context, _, said = user.removeprefix("CONTEXT:\n").rpartition("\n\nANSWER:\n")
        missing = [n for n in re.findall(r"\d+", re.sub(r"\[\d+\]", "", said)) if n not in context]
        return (f"Not in the context: {', '.join(missing)}" if missing else "NONE"), {}


def context_blocks(chunks: DataFrame) -> DataFrame:
    """(query_id, context, chunks): texts numbered from 1 in order of ``position``, and what they are."""
    rows = F.array_sort(F.collect_list(F.struct("position", "id", "parent_doc_id", "source", "text")))
    return chunks.groupBy("query_id").agg(rows.alias("chunks")).withColumn("context", numbered(F.col("chunks")))


def numbered(chunks: Column) -> Column:
    """The texts of an array of chunks, each after its position."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), c["position"].cast("string"), F.lit("] "), F.coalesce(c["text"], F.lit("")))), "\n")


def user_prompt(context: Column, query: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query)


def map_citations(answer: Column, chunks: Column) -> Column:
    """Array of (marker, chunk_id, parent_doc_id, source) for the answer's markers that number one of ``chunks``,
    an array of structs with id, parent_doc_id and source; markers out of range are dropped."""
    valid = F.filter(citation_markers(answer), lambda m: (m >= 1) & (m <= F.size(chunks)))
    return F.transform(
        valid,
        lambda m: F.struct(
            m.alias("marker"), F.get(chunks, m - 1)["id"].alias("chunk_id"), F.get(chunks, m - 1)["parent_doc_id"].alias("parent_doc_id"), F.get(chunks, m - 1)["source"].alias("source")
        ),
    )


def generate(prompts: DataFrame, model: Callable[[], LanguageModel] = Extractive, system: str = config.ANSWER_RULES) -> DataFrame:
    """(query_id, answer, usage, ms, error): the model's reply to each (query_id, prompt), written out, so that no later
    action asks the model again; one client per task.

    A null prompt stands for an empty context: it gets a fixed answer, no usage, and never reaches the model. A reply
    that fails leaves a null answer and the error; the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["query_id"], batch["prompt"]):
                begun, answer, usage, error = time.monotonic(), config.EMPTY_CONTEXT_ANSWER, None, None
                if prompt is not None:
                    try:
                        answer, usage = with_retries(lambda p=prompt: client.complete(system, p))
                    except Exception as e:
                        answer, error = None, str(e) or type(e).__name__
                usage = usage and {k: int(usage.get(k) or 0) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}
                rows.append((key, answer, usage, 1000 * (time.monotonic() - begun), error))
            yield pd.DataFrame(rows, columns=["query_id", "answer", "usage", "ms", "error"])

    kind = dict(prompts.dtypes)["query_id"]
    return written(prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string, usage {USAGE}, ms double, error string"), "replies")


USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
CHUNK_IDS = "array<struct<id:string,parent_doc_id:string,source:string>>"
CONTEXT = "array<struct<chunk_id:string,text:string>>"
CITATIONS = "array<struct<marker:int,chunk_id:string,parent_doc_id:string,source:string>>"
SCORES = "array<struct<chunk_id:string,score:double>>"


def ask_questions(passages: DataFrame, model: Callable[[], LanguageModel]) -> DataFrame:
    """(query_id, query) from (query_id, text): a question that each passage answers; passages the model fails on drop out."""
    asked = generate(passages.select("query_id", F.col("text").alias("prompt")), model, config.QUESTION_RULES)
    return asked.select("query_id", clean_question(F.col("answer")).alias("query")).filter("query <> ''")


def judge(answers: DataFrame, contexts: DataFrame, model: Callable[[], LanguageModel]) -> DataFrame:
    """(query_id, answer, verdict) of ``answers`` (query_id, answer) by ``contexts`` (query_id, context); refusals are not judged."""
    open_ = answers.filter(~is_refusal(F.col("answer"))).join(contexts, "query_id")
    prompts = open_.select("query_id", F.concat(F.lit("CONTEXT:\n"), "context", F.lit("\n\nANSWER:\n"), "answer").alias("prompt"))
    verdicts = generate(prompts, model, config.JUDGE_RULES).select("query_id", F.col("answer").alias("verdict"))
    return open_.select("query_id", "answer").join(verdicts, "query_id")


def check_answers(
    queries: DataFrame, chunks: DataFrame, docs: DataFrame, as_of: Column, model: Callable[[], LanguageModel] = Extractive,
    judged_by: Callable[[], LanguageModel] = NumberJudge, rows: int | None = config.JUDGE_SAMPLE,
) -> DataFrame:
    """One row: of ``rows`` queries (chosen by a hash; all for None), answered and judged, how many answers were judged and
    flagged, and their share; see ``unsupported_rate``."""
    chosen = queries if rows is None else written(hash_sample(queries, F.col("query_id"), rows, config.SAMPLE_SEED), "chosen")
    answers = answer(chosen, chunks, docs, as_of, model=model).filter("answer is not null")
    return evaluation.unsupported_rate(judge(answers, evaluation.judged_context(answers, chunks), judged_by))


class Found(NamedTuple):
    """Hits of one query set after each stage, written out: (query_id, rank, id, ...), without their texts."""

    fused: DataFrame
    scored: DataFrame


def find(queries: DataFrame, chunks: DataFrame, docs: DataFrame, as_of: Column, logit: Column | None = None) -> Found:
    """The fused hits of every query, and the reranked ones with source, sub-scores and confidence.

    ``queries`` has query_id, query and vector; ``chunks`` has chunk_id, parent_doc_id, text and embedding, and is read
    more than once, so write it first if it is costly to make. Hits are at most ``FUSED_TOP_K`` per query; up to
    ``MAX_QUERIES`` queries they are broadcast, so that texts and documents are looked up where they are read.
    """
    fused = written(retrieval.hybrid_search(queries, chunks, "chunk_id", "text", "embedding"), "fused")
    hits = _looked_up(fused.join(queries.select("query_id", "query"), "query_id"), chunks, "parent_doc_id", "text")
    logit = retrieval.lexical_logit(F.col("query"), F.col("text")) if logit is None else logit
    hits = written(hits.withColumn("rerank_score", logit).drop("query", "text"), "hits")  # scored where the texts are read; these stay there
    wanted = hits.select(F.col("parent_doc_id").alias("doc_id")).distinct()
    docs = docs.join(F.broadcast(wanted) if _few(hits) else wanted, "doc_id", "left_semi")
    reranked = retrieval.rerank(hits, F.col("rerank_score"))
    found = confidence.with_source(reranked, docs)
    found = found.withColumns(confidence.parts(as_of, found))
    return Found(fused, written(confidence.with_confidence(found, as_of), "scored"))


def _few(hits: DataFrame) -> bool:
    most = config.FUSED_TOP_K * retrieval.MAX_QUERIES
    return hits.limit(most + 1).count() <= most


def _looked_up(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """``hits`` with columns of their chunks, broadcast if they are few."""
    return chunks.select(F.col("chunk_id").alias("id"), *columns).join(F.broadcast(hits) if _few(hits) else hits, "id")


def retrieve(queries: DataFrame, chunks: DataFrame, docs: DataFrame, as_of: Column, logit: Column | None = None) -> DataFrame:
    """The reranked hits of every query with source, sub-scores and confidence: (query_id, rank, id, text, ...); see ``find``."""
    return _looked_up(find(queries, chunks, docs, as_of, logit).scored, chunks, "text")


class Answered(NamedTuple):
    """Answers, a trace of each query, and the rows to add to the cache."""

    answers: DataFrame
    traces: DataFrame
    cache: DataFrame


def answer(queries: DataFrame, chunks: DataFrame, docs: DataFrame, as_of: Column, threshold: float = config.CONFIDENCE_THRESHOLD, model: Callable[[], LanguageModel] = Extractive, cached: DataFrame | None = None) -> DataFrame:
    """(query_id, query, from_cache, answer, citations, context_chunks, usage, error) of every query; see ``answer_and_record``."""
    return answer_and_record(queries, chunks, docs, as_of, threshold, model, cached).answers


def answer_and_record(queries: DataFrame, chunks: DataFrame, docs: DataFrame, as_of: Column, threshold: float = config.CONFIDENCE_THRESHOLD, model: Callable[[], LanguageModel] = Extractive, cached: DataFrame | None = None) -> Answered:
    """Answers to a query set (query_id, query, vector), with what is to be stored of them.

    Living answers of ``cached`` (query_id, result, hit) are used as they are. A query without any chunk over the threshold
    gets the refusal and never reaches the model. A query the model fails on has no answer, its error in the
    trace, and is not cached. Refusals are cached like answers. The trace names of each stage ids and scores, no texts.
    """
    queries = written(queries.select("query_id", "query", "vector"), "asked")
    asked, hits = queries, None
    if cached is not None:
        hits = written(cached.filter("hit").select("query_id", "result"), "cached")
        asked = queries.join(hits.select("query_id"), "query_id", "left_anti")
    fused, scored = find(asked, chunks, docs, as_of)
    passed = written(confidence.gate(scored, threshold), "passed")
    # The texts of these are written once, here; what follows carries ids, until the answers are put together.
    blocks = written(context_blocks(_looked_up(passed, chunks, "text")).drop("context").join(asked.select("query_id", "query"), "query_id"), "blocks")
    replies = generate(blocks.withColumn("prompt", user_prompt(numbered(F.col("chunks")), F.col("query"))), model)
    made = written(
        asked.select("query_id", "query")
        .join(blocks.select("query_id", F.transform("chunks", lambda c: F.struct(c["id"].alias("id"), c["parent_doc_id"].alias("parent_doc_id"), c["source"].alias("source"))).alias("chunks")), "query_id", "left")
        .join(replies, "query_id", "left")
        .withColumn("answer", F.when(F.col("chunks").isNull(), F.lit(config.REFUSAL)).otherwise(F.col("answer")))
        .withColumn("chunks", F.coalesce("chunks", F.array().cast(CHUNK_IDS)))
        .select(
            "query_id", "query", F.lit(False).alias("from_cache"), "answer",
            map_citations(F.col("answer"), F.col("chunks")).alias("citations"),
            "usage", "error", "ms", (F.size("chunks") == 0).alias("gated"),
        ),
        "answers",
    )
    contexts = blocks.select("query_id", F.transform("chunks", lambda c: F.struct(c["id"].alias("chunk_id"), c["text"].alias("text"))).alias("context_chunks"))
    full = made.join(contexts, "query_id", "left").withColumn("context_chunks", F.coalesce("context_chunks", F.array().cast(CONTEXT)))
    out = full.select("query_id", "query", "from_cache", "answer", "citations", "context_chunks", "usage", "error")
    if hits is not None:
        out = out.unionByName(
            queries.select("query_id", "query").join(hits, "query_id").select(
                "query_id", "query", F.lit(True).alias("from_cache"), F.col("result.answer").alias("answer"),
                F.transform("result.citations", lambda c: F.struct(c["marker"].alias("marker"), c["chunk_id"].alias("chunk_id"), F.lit(None).cast("string").alias("parent_doc_id"), F.lit(None).cast("string").alias("source"))).alias("citations"),
                F.transform("result.context_chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"))).alias("context_chunks"),
                F.lit(None).cast(USAGE).alias("usage"), F.lit(None).cast("string").alias("error"),
            )
        )
    cache = full.filter("error is null").select(
        cache_key(F.col("query")).alias("cache_key"), "query",
        F.struct("answer", F.transform("citations", lambda c: F.struct(c["marker"].alias("marker"), c["chunk_id"].alias("chunk_id"))).alias("citations"), "context_chunks").alias("result"),
        as_of.alias("created_at"),
    )
    return Answered(out, traces_of(queries, made, fused, scored, passed, as_of), cache)


def snapshot(hits: DataFrame, score: str, order: str, into: str) -> DataFrame:
    """(query_id, ``into``): ids and scores of the hits of each query in their order, at most as many as a search keeps."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("id").alias("chunk_id"), F.col(score).alias("score"))))
    return hits.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.transform("rows", lambda r: F.struct(r["chunk_id"].alias("chunk_id"), r["score"].alias("score"))).cast(SCORES).alias(into))


def traces_of(queries: DataFrame, made: DataFrame, fused: DataFrame, scored: DataFrame, passed: DataFrame, as_of: Column) -> DataFrame:
    """(trace_id, query, started_at, stages, duration_ms, success, error, recorded_at) of every query: the stages are JSON with one key
    each, in order: cache, retrieval, rerank, confidence, generation, citations; after a hit in the cache it is the last."""
    none = F.array().cast(SCORES)
    all_ = queries.select("query_id", "query")
    for part in (snapshot(fused, "rrf_score", "rank", "retrieval"), snapshot(scored, "rerank_score", "rank", "rerank"), snapshot(passed, "confidence_score", "position", "confidence")):
        all_ = all_.join(part, "query_id", "left")
    all_ = all_.join(made.select("query_id", "usage", "citations", "ms", "error", "gated"), "query_id", "left")
    hit = F.col("gated").isNull()
    stage = lambda name: F.struct(F.coalesce(name, none).alias("chunks"))
    generation = F.when(F.col("gated"), F.struct(F.lit(True).alias("skipped"), F.lit("insufficient_evidence").alias("reason"), F.lit(None).cast(USAGE).alias("token_usage"))).otherwise(
        F.struct(F.lit(None).cast("boolean").alias("skipped"), F.lit(None).cast("string").alias("reason"), F.col("usage").alias("token_usage"))
    )
    done = F.when(F.col("error").isNull(), F.struct(F.coalesce("citations", F.array().cast(CITATIONS)).alias("citations")))
    whole = F.to_json(F.struct(
        F.struct(hit.alias("hit")).alias("cache"), stage("retrieval").alias("retrieval"), stage("rerank").alias("rerank"), stage("confidence").alias("confidence"),
        F.when(F.col("error").isNull(), generation).alias("generation"), done.alias("citations"),
    ))
    return all_.select(
        F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), as_of.cast("string")), 256).alias("trace_id"), "query", as_of.alias("started_at"),
        F.when(hit, F.to_json(F.struct(F.struct(hit.alias("hit")).alias("cache")))).otherwise(whole).alias("stages"),
        F.coalesce("ms", F.lit(0.0)).alias("duration_ms"), F.col("error").isNull().alias("success"), "error", as_of.alias("recorded_at"),
    )
