"""All queries of the core: name -> f(spark, folder), and their SQL for comparison.

Each runs over whole tables. Times are compared at the fixed instant AS_OF, so that results do not depend on the
day. A query of a search is a row of eval_set or adversarial_queries; for vectors, every 50th of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions import scores, text, vectors
from corpuskiln.operators import chunking, confidence, retrieval, store

from corpuskiln.plans import answering, evaluation
from corpuskiln.sources import files
from corpuskiln.tables import read, spread, written

AS_OF = "2024-03-01 00:00:00"
DIMS = 64
#: how the stored answers say that there is no evidence
STORED_REFUSAL = "I don't have enough grounded context for that."
PROBE = "cup in"
CAUGHT_PROBE = "stew"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk_id, the newest."""
    return store.latest_of_few(spread(read(spark, folder, "chunks")), "chunk_id", F.col("metadata.processed_at"))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query, label, source_doc_id, vector) of the evaluation and the adversarial queries."""
    genuine = read(spark, folder, "eval_set").select("query", F.lit("genuine").alias("label"), "source_doc_id")
    other = read(spark, folder, "adversarial_queries").select("query", F.lit("adversarial").alias("label"), F.lit(None).cast("string").alias("source_doc_id"))
    return genuine.unionByName(other).select(
        F.sha2(F.concat_ws("|", "label", "query", "source_doc_id"), 256).alias("query_id"), "query", "label", "source_doc_id", vectors.hashed_terms(F.col("query"), DIMS).alias("vector")
    )


def encoded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Stored chunks with the offline encoder's vectors in place of the stored ones, so that queries can be compared;
    written once, as searches read them more than once."""
    chunks = stored_chunks(spark, folder).select("chunk_id", "parent_doc_id", "text")
    return written(chunks.withColumn("embedding", vectors.hashed_terms(F.col("text"), DIMS)), "encoded")


def bm25_topk(spark, folder):
    return retrieval.keyword_search(asked(spark, folder), stored_chunks(spark, folder), "chunk_id")


def knn_topk(spark, folder):
    rows = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.vector_search(rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), rows, "id")


def hybrid_search(spark, folder):
    hits = retrieval.hybrid_search(asked(spark, folder), encoded_chunks(spark, folder), "chunk_id", "text", "embedding")
    return hits.select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"), F.concat_ws("+", "retrieved_by").alias("retrieved_by"), "rank")


def rrf_fusion(spark, folder):
    """Fusion of three rankings of the documents of each source: by length, by age and by id."""
    docs = read(spark, folder, "documents").select(F.lower(text.strip(F.col("source"))).alias("query_id"), F.col("doc_id").alias("id"), "n_chars", "collected_at").filter("query_id is not null")
    orders = [[F.desc("n_chars"), F.asc("id")], [F.desc("collected_at"), F.asc("id")], [F.asc("id")]]
    lists = [retrieval.ranked(docs, o, 20).select("query_id", "id", "rank") for o in orders]
    return retrieval.fuse_ranks(lists[0].unionByName(lists[1]).unionByName(lists[2])).select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"))


def _found(spark, folder) -> DataFrame:
    return answering.find(asked(spark, folder), encoded_chunks(spark, folder), read(spark, folder, "docs"), as_of()).scored


def lexical_rerank(spark, folder):
    return _found(spark, folder).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "fused_rank", "rank")


def confidence_gate(spark, folder):
    passed = confidence.gate(_found(spark, folder))
    return passed.select("query_id", "id", "source", F.round("confidence_score", 6).alias("confidence_score"), "position")


def best_chunk(spark, folder):
    best = evaluation.best_chunks(_found(spark, folder))
    return best.select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("confidence_score", "freshness", "trust", "overlap", "relevance")])


def source_lookup(spark, folder):
    hits = read(spark, folder, "chunks").select("chunk_id", "parent_doc_id").distinct()
    return confidence.with_source(hits, read(spark, folder, "docs")).select("chunk_id", "parent_doc_id", "source")


def sub_scores(spark, folder):
    """Freshness and trust of every document, overlap and relevance from what its metadata holds."""
    docs = read(spark, folder, "docs").select("doc_id", "metadata.*")
    logit = F.when(F.col("trust_score").isNotNull(), (F.col("trust_score") - 0.5) * 100)
    by = F.when(F.col("file_type") == "md", F.array(F.lit("keyword"), F.lit("vector"))).when(F.col("file_type") == "txt", F.array(F.lit("vector"), F.lit("vector")))
    got = {"freshness": scores.freshness(F.col("processed_at"), as_of()), "trust": scores.trust(F.col("source_file")), "overlap": scores.overlap(by), "relevance": scores.relevance(logit)}
    return docs.select("doc_id", *[F.round(v, 6).alias(k) for k, v in got.items()], F.round(scores.weighted(got), 6).alias("confidence"))


def citation_map(spark, folder):
    """Markers of the newest stored answers mapped to their context chunks."""
    newest = store.latest(read(spark, folder, "query_cache"), "cache_key", F.col("created_at"), F.col("query")).filter("result is not null")
    chunks = F.transform("result.context_chunks", lambda c: F.struct(c["chunk_id"].alias("id"), F.split_part(c["chunk_id"], F.lit(":"), F.lit(1)).alias("parent_doc_id"), F.lit(None).cast("string").alias("source")))
    mapped = newest.select("cache_key", F.explode(answering.map_citations(F.col("result.answer"), chunks)).alias("c"))
    return mapped.select("cache_key", "c.marker", "c.chunk_id", "c.parent_doc_id")


def refusal_flag(spark, folder):
    return read(spark, folder, "query_cache").filter("result is not null").select("cache_key", "created_at", text.is_refusal(F.col("result.answer"), STORED_REFUSAL).alias("refused")).distinct()


def gate_rate(spark, folder):
    newest = store.latest(read(spark, folder, "query_cache"), "cache_key", F.col("created_at"), F.col("query")).filter("result is not null")
    return evaluation.gate_rate(newest.select(F.col("result.answer").alias("answer")), STORED_REFUSAL).withColumn("gate_rate", F.round("gate_rate", 9))


def context_prompt(spark, folder):
    """Prompts from the first three chunks of every document with one."""
    chunks = stored_chunks(spark, folder).select(F.col("parent_doc_id").alias("query_id"), F.col("chunk_id").alias("id"), "parent_doc_id", F.lit(None).cast("string").alias("source"), "text", "chunk_index")
    first = retrieval.ranked(chunks, [F.asc("chunk_index")], 3, into="position")
    blocks = answering.context_blocks(first)
    return blocks.select("query_id", answering.user_prompt(F.col("context"), F.lit("What is this about?")).alias("prompt"))


def doc_identity(spark, folder):
    docs = read(spark, folder, "docs")
    return docs.select("doc_id", text.doc_id(F.col("metadata.source_file"), F.col("content").cast("binary")).alias("identity"))


def cache_keys(spark, folder):
    return read(spark, folder, "query_cache").select("cache_key", text.cache_key(F.col("query")).alias("key")).distinct()


def cache_lookup(spark, folder):
    """Every query of the traces looked up in the cache, with a lifetime of sixty days."""
    queries = read(spark, folder, "traces").filter("query is not null").groupBy(F.col("trace_id").alias("query_id")).agg(F.min("query").alias("query"))
    found = store.cached_answers(queries, read(spark, folder, "query_cache"), as_of(), 60 * 86400)
    return found.select("query_id", "cache_key", "hit", F.col("result.answer").alias("answer"))


def cache_upsert(spark, folder):
    cache = read(spark, folder, "query_cache")
    again = cache.filter("hour(created_at) < 6").withColumn("created_at", F.col("created_at") + F.expr("interval 1 day"))
    return store.upserted(cache, again).select("cache_key", "query", "created_at", F.col("result.answer").alias("answer"))


def ttl_expire(spark, folder):
    cache = store.alive(read(spark, folder, "query_cache"), "created_at", as_of(), 20 * 86400).select(F.lit("cache").alias("kind"), F.col("cache_key").alias("key"), F.col("created_at").alias("at"))
    traces = store.alive(read(spark, folder, "traces"), "started_at", as_of(), config.TRACE_TTL).select(F.lit("trace").alias("kind"), F.col("trace_id").alias("key"), F.col("started_at").alias("at"))
    return cache.unionByName(traces).groupBy("kind", "key").agg(F.max("at").alias("at"))


def dedup_anti(spark, folder):
    """Documents among the traces' hits that are not stored in docs, and stored ones that no trace found."""
    docs = read(spark, folder, "docs").select("doc_id")
    cited = store.latest(read(spark, folder, "traces"), "trace_id", F.col("recorded_at")).select(
        F.explode(F.from_json("stages", "retrieval struct<hits:array<struct<chunk_id:string,score:double>>>")["retrieval"]["hits"]["chunk_id"]).alias("chunk_id")
    ).select(F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("doc_id")).distinct()
    return store.new_rows(docs, cited, "doc_id").withColumn("kind", F.lit("never found")).unionByName(store.new_rows(cited, docs, "doc_id").withColumn("kind", F.lit("not stored")))


def orphan_docs(spark, folder):
    return store.orphans(read(spark, folder, "docs"), read(spark, folder, "chunks")).select("doc_id")


def healed_docs(spark, folder):
    return store.without_orphans(read(spark, folder, "docs"), read(spark, folder, "chunks")).select("doc_id", F.col("metadata.source_file").alias("source_file"))


def chunk_counts(spark, folder):
    return store.chunk_counts(read(spark, folder, "docs"), read(spark, folder, "chunks"))


def ingest_status(spark, folder):
    """Loading all documents again into a store of those filed before 2024."""
    docs = read(spark, folder, "docs")
    stored = docs.filter("metadata.processed_at < timestamp'2024-01-01'")
    return store.status_counts(store.ingest_status(docs, stored, read(spark, folder, "chunks")))


def html_extract(spark, folder):
    """Documents set as pages, with escaped text, a title, a script and a style, and read back."""
    docs = read(spark, folder, "docs")
    escaped = F.col("content")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("é", "&eacute;"), ("ü", "&#252;"), ("ö", "&#xF6;"), ("’", "&rsquo;"), ("—", "&mdash;"), ("€", "&euro;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><title> T "), F.col("doc_id"), F.lit(" </title><style>p { x: 1 }</style><script>if (a < b) { c(); }</script></head><body><!-- menu --><h1>&copy; x</h1><p class='a'>"),
        F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"),
    )
    return docs.select("doc_id", text.html_text(page).alias("text"), text.html_title(page).alias("title"))


def title_keyword_filter(spark, folder):
    """Documents whose title has a wanted word; the words of the fixed list and common ones of this collection."""
    titles = read(spark, folder, "docs").select("doc_id", text.title_of(F.col("content")).alias("title"), "content")
    words = (*config.TITLE_KEYWORDS, "kernel", "protocol", "model", "heap")
    return titles.filter(text.not_blank(F.col("content")) & text.title_matches(F.col("title"), words)).select("doc_id", "title")


def wiki_docs(spark, folder):
    return read(spark, folder, "docs").filter(F.col("metadata.source_file").rlike("wiki_")).select("doc_id", F.col("metadata.source_file").alias("source_file"))


def fixed_window_chunks(spark, folder):
    chunks = chunking.fixed_windows(read(spark, folder, "documents"), "doc_id", "text", 50, 5)
    return chunks.select("chunk_id", "parent_doc_id", "chunk_index", "text")


def recursive_chunks(spark, folder):
    return chunking.recursive_chunks(read(spark, folder, "docs")).select("chunk_id", "parent_doc_id", "chunk_index", "text")


def longest_chunk(spark, folder):
    return chunking.longest_chunks(stored_chunks(spark, folder)).select("parent_doc_id", "chunk_id", F.length("text").alias("chars"))


def title_from_text(spark, folder):
    return read(spark, folder, "documents").select("doc_id", text.title_of(F.col("text")).alias("title"), text.extension(F.lower(F.concat(F.col("source"), F.lit(".MD")))).alias("extension"))


def recall_at_k(spark, folder):
    queries = asked(spark, folder).filter("label = 'genuine'")
    found = answering.find(queries, encoded_chunks(spark, folder), read(spark, folder, "docs"), as_of()).scored
    return evaluation.recall_at(found, queries).withColumn("recall", F.round("recall", 9))


def _best(spark, folder) -> DataFrame:
    return evaluation.best_confidence(asked(spark, folder), _found(spark, folder))


def threshold_sweep(spark, folder):
    return evaluation.threshold_sweep(_best(spark, folder).withColumn("best", F.round("best", 6)))


def threshold_recommend(spark, folder):
    best = _best(spark, folder).withColumn("best", F.round("best", 6))
    return evaluation.recommended_threshold(best).withColumn("threshold", F.round("threshold", 6))


def weight_sweep(spark, folder):
    swept = evaluation.weight_sweep(asked(spark, folder), _found(spark, folder), PROBE)
    return swept.withColumn("threshold", F.round("threshold", 6))


def weight_selected(spark, folder):
    """The scheme that passes all genuine queries that any scheme passes and catches a probe: here another probe than
    that of the sweep, one that a scheme catches."""
    swept = written(evaluation.weight_sweep(asked(spark, folder), _found(spark, folder), CAUGHT_PROBE), "swept")
    most = swept.agg(F.max("genuine_passed")).first()[0] or 0
    return evaluation.selected_scheme(swept, most).select("scheme", F.round("threshold", 6).alias("threshold"))


def confidence_extremes(spark, folder):
    best = _best(spark, folder).withColumn("best", F.round("best", 6))
    low, high = evaluation.extremes(best, "genuine", 6, False), evaluation.extremes(best, "adversarial", 6, True)
    return low.unionByName(high).select("query_id", "label", "best")


def judged_context(spark, folder):
    newest = store.latest(read(spark, folder, "query_cache"), "cache_key", F.col("created_at"), F.col("query")).filter("result is not null")
    answers = newest.select(F.col("cache_key").alias("query_id"), "result.*")
    return evaluation.judged_context(answers, stored_chunks(spark, folder))


def unsupported_rate(spark, folder):
    """Stored answers judged by a rule: flagged if a number in them is in none of the chunks they cite."""
    newest = store.latest(read(spark, folder, "query_cache"), "cache_key", F.col("created_at"), F.col("query")).filter("result is not null")
    answers = newest.select(F.col("cache_key").alias("query_id"), "result.*")
    contexts = evaluation.judged_context(answers, stored_chunks(spark, folder))
    numbers = F.regexp_extract_all(F.regexp_replace("answer", r"\[\d+\]", ""), F.lit(r"\d+"), F.lit(0))
    judged = answers.join(contexts, "query_id").withColumn("verdict", F.when(F.forall(numbers, lambda n: F.contains("context", n)), " none. ").otherwise("A number."))
    return evaluation.unsupported_rate(judged, STORED_REFUSAL).withColumn("rate", F.round("rate", 9))


def hash_sample_docs(spark, folder):
    """Thirty documents by the least SHA-256 of a seed and their id, as evaluation questions are drawn."""
    docs = read(spark, folder, "docs").filter(F.col("metadata.source_file").rlike("wiki_"))
    place = F.sha2(F.concat(F.lit(f"{config.SAMPLE_SEED}:"), F.col("doc_id")), 256)
    return docs.select("doc_id", place.alias("place")).orderBy("place").limit(config.EVAL_SAMPLE)


def trace_rollup(spark, folder):
    return store.trace_rollup(read(spark, folder, "traces"))


def trace_stages(spark, folder):
    stages = store.trace_stages(read(spark, folder, "traces"))
    return stages.groupBy("stage").agg(F.count("*").alias("traces"))


def answer_batch(spark, folder):
    """Answers to the evaluation, the adversarial and all cached queries, living cached answers reused."""
    log = store.latest(read(spark, folder, "query_cache"), "cache_key", F.col("created_at"), F.col("query"))
    again = log.select(F.col("cache_key").alias("query_id"), "query", vectors.hashed_terms(F.col("query"), DIMS).alias("vector"))
    queries = written(asked(spark, folder).select("query_id", "query", "vector").unionByName(again), "queries")
    cached = store.cached_answers(queries.select("query_id", "query"), log, as_of(), 60 * 86400)
    out = answering.answer(queries, encoded_chunks(spark, folder), read(spark, folder, "docs"), as_of(), cached=cached)
    return out.select("query_id", "query", "from_cache", "answer", "citations", "context_chunks", "usage", "error")


def _recorded(spark, folder) -> answering.Answered:
    return answering.answer_and_record(asked(spark, folder), encoded_chunks(spark, folder), read(spark, folder, "docs"), as_of())


def answer_traces(spark, folder):
    """The traces of answering the evaluation and the adversarial queries: the ids of each stage, in order."""
    traces = _recorded(spark, folder).traces
    chunk = "struct<chunks:array<struct<chunk_id:string>>>"
    stages = F.from_json("stages", f"cache struct<hit:boolean>, retrieval {chunk}, rerank {chunk}, confidence {chunk}, generation struct<skipped:boolean>")
    ids = [F.array_join(stages[s]["chunks"]["chunk_id"], "|").alias(s) for s in ("retrieval", "rerank", "confidence")]
    return traces.select("query", stages["cache"]["hit"].alias("hit"), *ids, F.coalesce(stages["generation"]["skipped"], F.lit(False)).alias("skipped"), "success")


def answer_cache(spark, folder):
    """The cache after these answers are added to it: whether an answer is a refusal, and its context."""
    cache = store.upserted(read(spark, folder, "query_cache"), _recorded(spark, folder).cache)
    return cache.select("cache_key", "created_at", text.is_refusal(F.col("result.answer")).alias("refused"), F.array_join("result.context_chunks.chunk_id", "|").alias("context"))


def grounded_answers(spark, folder):
    """Answers to the evaluation and the adversarial queries, and the chunk each cites."""
    answers = _recorded(spark, folder).answers
    return answers.select("query", "answer", F.array_join("citations.chunk_id", "|").alias("cited"))


def answers_checked(spark, folder):
    """All these answers judged by the offline judge."""
    return answering.check_answers(asked(spark, folder), encoded_chunks(spark, folder), read(spark, folder, "docs"), as_of(), rows=None)


def loaded_files(spark, folder):
    """Documents set as files, some of an unsupported type, and loaded again."""
    suffix = F.when(F.col("metadata.file_type") == "txt", "txt").when(F.col("metadata.file_type") == "md", "xyz").otherwise("TXT")
    raw = read(spark, folder, "docs").select(F.concat_ws(".", "doc_id", suffix).alias("path"), F.col("content").cast("binary").alias("content"))
    return files.documents(raw, as_of()).select("doc_id", "metadata.source_file", "metadata.file_type", "status", "reason", "content")


def article_filter(spark, folder):
    """Documents as articles whose title has a wanted word."""
    titled = read(spark, folder, "docs").select("doc_id", F.col("metadata.custom")["title"].alias("title"), "content")
    words = (*config.TITLE_KEYWORDS, "kernel", "protocol", "model", "heap")
    return files.matching_articles(titled, "doc_id", "title", "content", None, None, words)


def question_cleanup(spark, folder):
    """The traces' queries in quotation marks, as a model returns questions, and without them."""
    asked_ = read(spark, folder, "traces").filter("query is not null")
    return asked_.select("trace_id", text.clean_question(F.concat(F.lit('"'), "query", F.lit('" '))).alias("question")).distinct()


def adversarial_gate(spark, folder):
    """Share of the adversarial queries that are refused when answered."""
    adversarial = asked(spark, folder).filter("label = 'adversarial'")
    answers = answering.answer(adversarial, encoded_chunks(spark, folder), read(spark, folder, "docs"), as_of())
    return evaluation.gate_rate(answers).withColumn("gate_rate", F.round("gate_rate", 9))


def chunk_vectors(spark, folder):
    """Usable stored vectors with their length and their cosine to the first chunk of their document."""
    chunks = stored_chunks(spark, folder).select("chunk_id", "parent_doc_id", "chunk_index", "embedding").filter((F.size("embedding") == DIMS) & F.exists("embedding", lambda x: x != 0))
    first = chunks.groupBy("parent_doc_id").agg(F.min_by("embedding", "chunk_index").alias("first"))
    return chunks.join(first, "parent_doc_id").select("chunk_id", F.round(vectors.norm(F.col("embedding")), 5).alias("length"), F.round(vectors.cosine(F.col("embedding"), F.col("first")), 5).alias("cosine"))


def index_postings(spark, folder):
    """Document frequency and collection frequency of every term of the stored chunks."""
    terms = retrieval.postings(stored_chunks(spark, folder), "chunk_id")
    return terms.groupBy("term").agg(F.count("*").alias("texts"), F.sum("frequency").alias("occurrences"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, knn_topk, rrf_fusion, hybrid_search, lexical_rerank, confidence_gate, best_chunk, source_lookup, sub_scores, citation_map, refusal_flag, gate_rate, context_prompt, doc_identity,
        cache_keys, cache_lookup, cache_upsert, ttl_expire, dedup_anti, orphan_docs, healed_docs, chunk_counts, ingest_status, html_extract, title_keyword_filter, wiki_docs, fixed_window_chunks,
        recursive_chunks, longest_chunk, title_from_text, recall_at_k, threshold_sweep, threshold_recommend, weight_sweep, weight_selected, confidence_extremes, judged_context, unsupported_rate,
        hash_sample_docs, trace_rollup, trace_stages, answer_batch, answer_traces, answer_cache, grounded_answers, answers_checked, adversarial_gate, loaded_files, article_filter, question_cleanup, chunk_vectors, index_postings,
    )
}
from corpuskiln.plans.registry_sql import SQL  # noqa: E402, F401
