"""DuckDB SQL of the core queries, over the same tables, for comparison of results."""

from __future__ import annotations

from corpuskiln import config

AS_OF = "TIMESTAMPTZ '2024-03-01 00:00:00+00'"
REFUSED = "i don''t have enough grounded context for that."

TERMS = r"list_filter(regexp_split_to_array(replace(lower({}), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def terms(x: str) -> str:
    return TERMS.format(x)


def bucket(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 7))::BIGINT % 64)"


LATEST_CHUNKS = "latest AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY metadata.processed_at DESC NULLS LAST) = 1)"
LATEST_CACHE = "newest AS (SELECT * FROM query_cache QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC NULLS LAST, query) = 1)"
LATEST_TRACES = "newest AS (SELECT * FROM traces QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY recorded_at DESC NULLS LAST) = 1)"

ASKED = """asked AS (
  SELECT sha256(concat_ws('|', label, query, source_doc_id)) AS query_id, * FROM (
    SELECT query, 'genuine' AS label, source_doc_id FROM eval_set
    UNION ALL SELECT query, 'adversarial', NULL FROM adversarial_queries))"""

BM25 = f"""words AS (SELECT chunk_id AS id, {terms("coalesce(text, '')")} AS w FROM latest),
totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT id, len(w) AS dl, t, count(*) AS tf FROM (SELECT id, w, unnest(w) AS t FROM words) GROUP BY ALL),
want AS (SELECT query_id, unnest(list_distinct({terms("query")})) AS t FROM asked),
idf AS (SELECT t, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, totals WHERE t IN (SELECT t FROM want) GROUP BY t, n),
bm25 AS (SELECT query_id, id, round(sum(idf * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean)) ORDER BY t), 6) AS score
  FROM want JOIN idf USING (t) JOIN tf USING (t), totals GROUP BY query_id, id),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= 20)"""


def encoded(source: str, key: str, text: str) -> str:
    return f"""(SELECT {key}, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END) AS v, n FROM (
    SELECT {key}, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
      SELECT {key}, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM (
        SELECT {key}, list_transform({terms(text)}, lambda t: {bucket("t")}) AS b FROM {source}))))"""


VECTOR = f"""qv AS {encoded("asked", "query_id", "query")},
cv AS {encoded("latest", "chunk_id", "coalesce(text, '')")},
cosines AS (SELECT query_id, chunk_id AS id, round(list_sum(list_transform(list_zip(qv.v, cv.v), lambda z: z[1] * z[2])), 6) AS score FROM qv, cv WHERE cv.n > 0),
vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosines QUALIFY rank <= 20)"""

HYBRID = """fused AS (SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.id, v.id) AS id, k.rank AS kr, v.rank AS vr,
    coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS rrf_score
  FROM keyword k FULL JOIN vector v ON k.query_id = v.query_id AND k.id = v.id),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, kr NULLS LAST, vr NULLS LAST) AS rank FROM fused QUALIFY rank <= 10)"""

RERANK = f"""reranked AS (SELECT query_id, id, parent_doc_id, kr, vr, rank AS fused_rank,
    8.0::DOUBLE * (len(list_intersect(list_distinct({terms("query")}), list_distinct({terms("text")})))::DOUBLE / greatest(len(list_distinct({terms("query")})), 1)) - 4.0::DOUBLE AS rerank_score
  FROM hybrid JOIN asked USING (query_id) JOIN latest ON latest.chunk_id = id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS rank FROM reranked QUALIFY rank <= 5)"""

SCORED = """scored AS (SELECT *, least(1, greatest(0, 0.25::DOUBLE * freshness + 0.25::DOUBLE * trust + 0.25::DOUBLE * overlap + 0.25::DOUBLE * relevance)) AS confidence_score FROM (
  SELECT query_id, id, parent_doc_id, rank, metadata.source_file AS source, 0.3::DOUBLE AS freshness,
    CASE WHEN contains(metadata.source_file, 'wiki_') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS trust,
    ((kr IS NOT NULL)::INT + (vr IS NOT NULL)::INT) / 2.0::DOUBLE AS overlap, 1 / (1 + exp(-rerank_score)) AS relevance
  FROM top LEFT JOIN docs ON doc_id = parent_doc_id))"""

FOUND = f"WITH {ASKED}, {LATEST_CHUNKS}, {BM25}, {VECTOR}, {HYBRID}, {RERANK}, {SCORED}"
BEST = f"{FOUND}, best AS (SELECT query_id, label, query, round(max(confidence_score), 6) AS best FROM asked LEFT JOIN scored USING (query_id) GROUP BY ALL)"
ALL_BEST = BEST

WEIGHTS = """schemes(scheme, position, f, t, o, r) AS (VALUES ('A_baseline', 0, 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE), ('B_mild', 1, 0.15, 0.20, 0.20, 0.45),
  ('C_stronger', 2, 0.10, 0.15, 0.20, 0.55), ('D_aggressive', 3, 0.05, 0.10, 0.20, 0.65)),
bests AS (SELECT query_id, scheme, max(least(1, greatest(0, freshness * f + trust * t + overlap * o + relevance * r))) AS best FROM scored, schemes GROUP BY ALL),
every AS (SELECT a.query_id, a.query, a.label, s.scheme, s.position, b.best FROM asked a CROSS JOIN schemes s LEFT JOIN bests b ON b.query_id = a.query_id AND b.scheme = s.scheme),
low AS (SELECT scheme, greatest(min(best) - 0.01::DOUBLE, 0) AS threshold FROM every WHERE label = 'genuine' GROUP BY scheme),
swept AS (SELECT scheme, position, round(threshold, 6) AS threshold,
    count(*) FILTER (label = 'genuine' AND best >= threshold) AS genuine_passed,
    count(*) FILTER (label = 'adversarial' AND (best IS NULL OR best < threshold)) AS adversarial_gated,
    coalesce(bool_and(best IS NULL OR best < threshold) FILTER (label = 'adversarial' AND contains(query, 'cup in')), false) AS probe_caught
  FROM every JOIN low USING (scheme) GROUP BY ALL)"""

CITED = r"list_distinct(list_transform(regexp_extract_all(result.answer, '[\[【](\d+)[^\]】]*[\]】]', 1), lambda m: try_cast(m AS INT)))"
JUDGED = f"""{LATEST_CACHE}, {LATEST_CHUNKS},
answers AS (SELECT cache_key AS query_id, result.answer AS answer, result.citations AS citations, result.context_chunks AS context_chunks FROM newest WHERE result IS NOT NULL),
cited AS (SELECT query_id, list(text ORDER BY pos) AS cited FROM (
    SELECT query_id, unnest(citations).chunk_id AS chunk_id, generate_subscripts(citations, 1) AS pos FROM answers) LEFT JOIN latest USING (chunk_id) WHERE chunk_id <> '' GROUP BY query_id),
contexts AS (SELECT query_id, answer, coalesce(nullif(array_to_string(list_filter(list_transform(coalesce(cited, list_transform(context_chunks, lambda c: c.text)),
      lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), chr(10) || chr(10)), ''), '{config.NO_CHUNKS}') AS context
  FROM answers LEFT JOIN cited USING (query_id))"""

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TITLE = r"coalesce(regexp_extract(split_part({0}, chr(10), 1), '(?i)^\s*title:\s*(.*?)\s*$', 1), '')"


def strip(x: str) -> str:
    return STRIP.format(x)


def title(x: str) -> str:
    return TITLE.format(x)


KEYWORDS = "|".join((*config.TITLE_KEYWORDS, "kernel", "protocol", "model", "heap"))


def refused(answer: str, text: str) -> str:
    return rf"coalesce(lower(trim(regexp_replace({answer}, '\s+', ' ', 'g'))) = '{text}', false)"


PASSED = """passed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence_score DESC, rank) AS position FROM scored WHERE confidence_score >= 0.515::DOUBLE),
contexts AS (SELECT query_id, string_agg(id, '|' ORDER BY position) AS context, arg_min(id, position) AS first FROM passed GROUP BY query_id)"""

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[{SPACE}]*[^{SPACE}]+|[{SPACE}]+\\z')"


def split_level(level: int, separator: str) -> str:
    """Parts of the level before, those over 500 words apart at the separator."""
    keep = f"SELECT doc_id, pos, p, n FROM l{level - 1} WHERE n <= 500"
    cut = f"SELECT doc_id, list_append(pos, i) AS pos, p, len({words('p')}) AS n FROM (SELECT doc_id, pos, unnest(string_split(p, {separator})) AS p, generate_subscripts(string_split(p, {separator}), 1) AS i FROM l{level - 1} WHERE n > 500) WHERE p <> ''"
    return f"l{level} AS ({keep} UNION ALL {cut})"


RECURSIVE = f"""WITH RECURSIVE l0 AS (SELECT doc_id, []::BIGINT[] AS pos, content AS p, len({words('content')}) AS n FROM docs),
  {split_level(1, "chr(10) || chr(10)")}, {split_level(2, "chr(10)")}, {split_level(3, "'. '")}, {split_level(4, "' '")},
  tokens AS (SELECT doc_id, flatten(list({words('p')} ORDER BY pos)) AS t, list(n ORDER BY pos) AS sizes FROM l4 WHERE doc_id IN (SELECT doc_id FROM l0 WHERE n > 500) GROUP BY doc_id),
  ends AS (SELECT doc_id, list_transform(sizes, lambda x, i: list_sum(sizes[1:i]))::BIGINT[] AS ends FROM tokens),
  steps AS (
    SELECT doc_id, 1::BIGINT AS k, 0::BIGINT AS s, 0::BIGINT AS e, NULL::BIGINT AS a, NULL::BIGINT AS b FROM ends
    UNION ALL
    SELECT doc_id, CASE WHEN done - s <= 500 OR greatest(s, e - 50) + 500 >= done THEN k + 1 ELSE k END, CASE WHEN done - s <= 500 THEN s ELSE greatest(s, e - 50) END,
      CASE WHEN done - s <= 500 THEN done ELSE least(done, greatest(s, e - 50) + 500) END, CASE WHEN done - s > 500 THEN s END, CASE WHEN done - s > 500 THEN e END
    FROM (SELECT doc_id, k, s, e, ends[k] AS done, len(ends) AS n FROM steps JOIN ends USING (doc_id)) WHERE k <= n),
  windows AS (SELECT doc_id, a, b FROM steps WHERE b IS NOT NULL UNION ALL SELECT doc_id, s, e FROM steps JOIN ends USING (doc_id) WHERE k > len(ends)),
  texts AS (SELECT doc_id, a, b, array_to_string(t[a + 1:b], '') AS text FROM windows JOIN tokens USING (doc_id) UNION ALL SELECT doc_id, 0, 0, p FROM l0 WHERE n <= 500),
  numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, a) - 1 AS chunk_index, text FROM texts WHERE regexp_matches(text, '[^{SPACE}]'))
  SELECT doc_id || ':' || chunk_index AS chunk_id, doc_id AS parent_doc_id, chunk_index::INT AS chunk_index, text FROM numbered"""

SQL = {
    "bm25_topk": f"WITH {ASKED}, {LATEST_CHUNKS}, {BM25} SELECT query_id, id, score, rank::INT AS rank FROM keyword",
    "knn_topk": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      u AS (SELECT id, list_transform(v, lambda x: x / n) AS v FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) WHERE n > 0),
      c AS (SELECT q.id AS query_id, d.id, round(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])), 6) AS score FROM u q, u d WHERE q.id % 50 = 0)
      SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM c QUALIFY rank <= 20""",
    "rrf_fusion": f"""WITH d AS (SELECT lower({strip("source")}) AS query_id, doc_id AS id, n_chars, collected_at FROM documents WHERE source IS NOT NULL),
      l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, id) AS rank FROM d QUALIFY rank <= 20
        UNION ALL (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY collected_at DESC, id) AS rank FROM d QUALIFY rank <= 20)
        UNION ALL (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM d QUALIFY rank <= 20))
      SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score FROM l GROUP BY ALL""",
    "hybrid_search": f"""WITH {ASKED}, {LATEST_CHUNKS}, {BM25}, {VECTOR}, {HYBRID}
      SELECT query_id, id, round(rrf_score, 9) AS rrf_score, concat_ws('+', CASE WHEN kr IS NOT NULL THEN 'keyword' END, CASE WHEN vr IS NOT NULL THEN 'vector' END) AS retrieved_by, rank::INT AS rank FROM hybrid""",
    "lexical_rerank": f"WITH {ASKED}, {LATEST_CHUNKS}, {BM25}, {VECTOR}, {HYBRID}, {RERANK} SELECT query_id, id, round(rerank_score, 6) AS rerank_score, fused_rank::INT AS fused_rank, rank::INT AS rank FROM top",
    "confidence_gate": f"{FOUND} SELECT query_id, id, source, round(confidence_score, 6) AS confidence_score, row_number() OVER (PARTITION BY query_id ORDER BY confidence_score DESC, rank)::INT AS position FROM scored WHERE confidence_score >= 0.515::DOUBLE",
    "best_chunk": f"""{FOUND} SELECT query_id, id, round(confidence_score, 6) AS confidence_score, freshness, trust, overlap, round(relevance, 6) AS relevance FROM scored
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence_score DESC, rank) = 1""",
    "source_lookup": "SELECT DISTINCT chunk_id, parent_doc_id, docs.metadata.source_file AS source FROM chunks LEFT JOIN docs ON doc_id = parent_doc_id",
    "sub_scores": f"""WITH s AS (SELECT doc_id,
        CASE WHEN metadata.processed_at IS NULL THEN 0.3::DOUBLE WHEN metadata.processed_at >= {AS_OF} THEN 1 ELSE exp(-(epoch_us({AS_OF}) - epoch_us(metadata.processed_at)) / 86400e6::DOUBLE / 365) END AS freshness,
        CASE WHEN contains(metadata.source_file, 'wiki_') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS trust,
        CASE metadata.file_type WHEN 'md' THEN 1.0::DOUBLE WHEN 'txt' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS overlap,
        CASE WHEN metadata.trust_score IS NULL THEN 0.5::DOUBLE ELSE 1 / (1 + exp(-(metadata.trust_score - 0.5::DOUBLE) * 100)) END AS relevance FROM docs)
      SELECT doc_id, round(freshness, 6) AS freshness, trust, overlap, round(relevance, 6) AS relevance, round(0.25::DOUBLE * (freshness + trust + overlap + relevance), 6) AS confidence FROM s""",
    "citation_map": f"""WITH {LATEST_CACHE}, m AS (SELECT cache_key, result.context_chunks AS c, unnest({CITED}) AS marker FROM newest WHERE result IS NOT NULL)
      SELECT cache_key, marker, c[marker].chunk_id AS chunk_id, split_part(c[marker].chunk_id, ':', 1) AS parent_doc_id FROM m WHERE marker BETWEEN 1 AND len(c)""",
    "refusal_flag": rf"SELECT DISTINCT cache_key, created_at, coalesce(lower(trim(regexp_replace(result.answer, '\s+', ' ', 'g'))) = '{REFUSED}', false) AS refused FROM query_cache WHERE result IS NOT NULL",
    "gate_rate": rf"""WITH {LATEST_CACHE}, a AS (SELECT coalesce(lower(trim(regexp_replace(result.answer, '\s+', ' ', 'g'))) = '{REFUSED}', false) AS r FROM newest WHERE result IS NOT NULL)
      SELECT count(*) AS answers, count(*) FILTER (r) AS refusals, round(count(*) FILTER (r) / count(*)::DOUBLE, 9) AS gate_rate FROM a""",
    "context_prompt": f"""WITH {LATEST_CHUNKS}, f AS (SELECT parent_doc_id AS query_id, text, row_number() OVER (PARTITION BY parent_doc_id ORDER BY chunk_index) AS position FROM latest QUALIFY position <= 3)
      SELECT query_id, 'Context:' || chr(10) || string_agg('[' || position || '] ' || coalesce(text, ''), chr(10) ORDER BY position) || chr(10) || chr(10) || 'Question: What is this about?' AS prompt FROM f GROUP BY query_id""",
    "doc_identity": """WITH h AS (SELECT doc_id, metadata.source_file AS f, regexp_extract_all(hex(encode(content)), '..') AS x FROM docs)
      SELECT doc_id, sha256(unhex(hex(encode(f || '::')) || array_to_string(list_transform(x, lambda b: CASE WHEN b < '8' THEN b WHEN b < 'C' THEN 'C2' || b ELSE 'C3' || translate(b[1], 'CDEF', '89AB') || b[2] END), ''))) AS identity FROM h""",
    "cache_keys": f"SELECT DISTINCT cache_key, sha256({strip('lower(query)')}) AS key FROM query_cache",
    "cache_lookup": f"""WITH living AS (SELECT * FROM query_cache WHERE created_at <= {AS_OF} AND created_at > {AS_OF} - INTERVAL 60 DAY),
      newest AS (SELECT * FROM living QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC NULLS LAST, query) = 1),
      q AS (SELECT trace_id AS query_id, min(query) AS query FROM traces WHERE query IS NOT NULL GROUP BY trace_id)
      SELECT query_id, sha256({strip("lower(q.query)")}) AS cache_key, result IS NOT NULL AS hit, result.answer AS answer FROM q LEFT JOIN newest ON newest.cache_key = sha256({strip("lower(q.query)")})""",
    "ttl_expire": f"""SELECT 'cache' AS kind, cache_key AS key, max(created_at) AS at FROM query_cache WHERE created_at <= {AS_OF} AND created_at > {AS_OF} - INTERVAL 20 DAY GROUP BY ALL
      UNION ALL SELECT 'trace', trace_id, max(started_at) FROM traces WHERE started_at <= {AS_OF} AND started_at > {AS_OF} - INTERVAL 7 DAY GROUP BY ALL""",
    "cache_upsert": """WITH w AS (SELECT * FROM query_cache UNION ALL BY NAME SELECT * REPLACE (created_at + INTERVAL 1 DAY AS created_at) FROM query_cache WHERE epoch_us(created_at) % 86400000000 < 21600000000)
      SELECT cache_key, query, created_at, result.answer AS answer FROM w QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC NULLS LAST, query) = 1""",
    "dedup_anti": f"""WITH {LATEST_TRACES}, cited AS (SELECT DISTINCT split_part(unnest(from_json(json_extract(stages, '$.retrieval.hits[*].chunk_id'), '["VARCHAR"]')), ':', 1) AS doc_id FROM newest WHERE json_valid(stages))
      SELECT doc_id, 'never found' AS kind FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM cited WHERE doc_id IS NOT NULL)
      UNION ALL SELECT doc_id, 'not stored' FROM cited WHERE doc_id NOT IN (SELECT doc_id FROM docs)""",
    "orphan_docs": "SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT parent_doc_id FROM chunks)",
    "healed_docs": "SELECT doc_id, metadata.source_file AS source_file FROM docs WHERE doc_id IN (SELECT parent_doc_id FROM chunks)",
    "chunk_counts": "SELECT doc_id, count(DISTINCT chunk_id) AS chunks FROM docs LEFT JOIN chunks ON parent_doc_id = doc_id GROUP BY doc_id",
    "ingest_status": """SELECT CASE WHEN metadata.processed_at < TIMESTAMPTZ '2024-01-01 00:00:00+00' AND doc_id IN (SELECT parent_doc_id FROM chunks) THEN 'skipped'
        WHEN coalesce(trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') = '' THEN 'failed' ELSE 'ingested' END AS status, count(*) AS documents FROM docs GROUP BY ALL""",
    "html_extract": rf"""SELECT doc_id, regexp_replace('T ' || doc_id || chr(10) || '© x' || chr(10) || array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda l: l <> ''), lambda l: {strip("l")}), chr(10)), '^\s+|\s+$', '', 'g') AS text, 'T ' || doc_id AS title FROM docs""",
    "title_keyword_filter": rf"""SELECT doc_id, {title("content")} AS title FROM docs WHERE {strip("content")} <> '' AND regexp_matches({title("content")}, '(?i)\b(?:{KEYWORDS})s?\b')""",
    "wiki_docs": "SELECT doc_id, metadata.source_file AS source_file FROM docs WHERE contains(metadata.source_file, 'wiki_')",
    "fixed_window_chunks": r"""WITH w AS (SELECT doc_id::VARCHAR AS parent_doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
      i AS (SELECT parent_doc_id, w, unnest(range(0, (greatest(len(w) - 6, 0) // 45) + 1))::INT AS chunk_index FROM w WHERE len(w) > 0)
      SELECT parent_doc_id || ':' || chunk_index AS chunk_id, parent_doc_id, chunk_index, array_to_string(w[chunk_index * 45 + 1 : chunk_index * 45 + 50], ' ') AS text FROM i""",
    "recursive_chunks": RECURSIVE,
    "longest_chunk": f"""WITH {LATEST_CHUNKS} SELECT parent_doc_id, chunk_id, length(text) AS chars FROM latest WHERE {strip("text")} <> ''
      QUALIFY row_number() OVER (PARTITION BY parent_doc_id ORDER BY length(text) DESC, chunk_index) = 1""",
    "title_from_text": f"SELECT doc_id, {title('text')} AS title, CASE WHEN source IS NULL THEN NULL ELSE 'md' END AS extension FROM documents",
    "recall_at_k": f"""{FOUND}, t AS (SELECT query_id, source_doc_id, min(rank) FILTER (parent_doc_id = source_doc_id) AS first FROM asked LEFT JOIN scored USING (query_id) WHERE label = 'genuine' GROUP BY ALL)
      SELECT k::INT AS k, count(*) FILTER (first <= k) AS hits, count(*) AS entries, round(count(*) FILTER (first <= k) / count(*)::DOUBLE, 9) AS recall FROM t, (VALUES (1), (3), (5)) ks(k) GROUP BY k""",
    "threshold_sweep": f"""{BEST} SELECT t::DOUBLE AS threshold, count(*) FILTER (label = 'genuine' AND best >= t::DOUBLE) AS genuine_passed, count(*) FILTER (label = 'adversarial' AND (best IS NULL OR best < t::DOUBLE)) AS adversarial_gated
      FROM best, (VALUES (0.40), (0.45), (0.50), (0.55), (0.60), (0.65), (0.70)) s(t) GROUP BY t""",
    "threshold_recommend": f"""{BEST}, low AS (SELECT greatest(min(best) - 0.01::DOUBLE, 0) AS threshold FROM best WHERE label = 'genuine')
      SELECT round(threshold, 6) AS threshold, count(*) FILTER (label = 'adversarial' AND (best IS NULL OR best < threshold)) AS gated, count(*) FILTER (label = 'adversarial' AND (best IS NULL OR best < threshold)) >= 3 AS accepted FROM best, low GROUP BY threshold""",
    "weight_sweep": f"{FOUND}, {WEIGHTS} SELECT scheme, position::INT AS position, threshold, genuine_passed, adversarial_gated, probe_caught FROM swept",
    "weight_selected": f"{FOUND}, {WEIGHTS} SELECT scheme, threshold FROM swept WHERE scheme IN ('B_mild', 'C_stronger', 'D_aggressive') AND genuine_passed = (SELECT max(genuine_passed) FROM swept) AND probe_caught ORDER BY position LIMIT 1".replace("cup in", "stew"),
    "confidence_extremes": f"""{BEST} (SELECT query_id, label, best FROM best WHERE label = 'genuine' ORDER BY best ASC NULLS LAST, query_id LIMIT 6)
      UNION ALL (SELECT query_id, label, best FROM best WHERE label = 'adversarial' ORDER BY best DESC NULLS LAST, query_id LIMIT 6)""",
    "judged_context": f"WITH {JUDGED} SELECT query_id, context FROM contexts",
    "unsupported_rate": rf"""WITH {JUDGED}, j AS (SELECT list_bool_and(list_transform(regexp_extract_all(regexp_replace(answer, '\[\d+\]', '', 'g'), '\d+'), lambda n: contains(context, n))) AS ok FROM contexts
        WHERE NOT coalesce(lower(trim(regexp_replace(answer, '\s+', ' ', 'g'))) = '{REFUSED}', false))
      SELECT count(*) AS judged, count(*) FILTER (NOT coalesce(ok, true)) AS flagged, round(count(*) FILTER (NOT coalesce(ok, true)) / count(*)::DOUBLE, 9) AS rate FROM j""",
    "answer_traces": f"""{FOUND}, {PASSED},
      r AS (SELECT query_id, string_agg(id, '|' ORDER BY rank) AS retrieval FROM hybrid GROUP BY query_id), t AS (SELECT query_id, string_agg(id, '|' ORDER BY rank) AS rerank FROM top GROUP BY query_id)
      SELECT query, false AS hit, coalesce(retrieval, '') AS retrieval, coalesce(rerank, '') AS rerank, coalesce(context, '') AS confidence, context IS NULL AS skipped, true AS success
      FROM asked LEFT JOIN r USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN contexts USING (query_id)""",
    "answer_cache": f"""{FOUND}, {PASSED}, written AS (
        SELECT cache_key, query, created_at, {refused("result.answer", config.REFUSAL.lower())} AS refused, array_to_string(list_transform(result.context_chunks, lambda c: c.chunk_id), '|') AS context FROM query_cache
        UNION ALL SELECT sha256({strip("lower(query)")}), query, {AS_OF}, context IS NULL, coalesce(context, '') FROM asked LEFT JOIN contexts USING (query_id))
      SELECT cache_key, created_at, refused, context FROM written QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC NULLS LAST, query) = 1""",
    "adversarial_gate": f"""{FOUND}, {PASSED} SELECT count(*) AS answers, count(*) FILTER (context IS NULL) AS refusals, round(count(*) FILTER (context IS NULL) / count(*)::DOUBLE, 9) AS gate_rate
      FROM asked LEFT JOIN contexts USING (query_id) WHERE label = 'adversarial'""",
    "grounded_answers": f"""{FOUND}, {PASSED} SELECT query, CASE WHEN first IS NULL THEN '{config.REFUSAL}' ELSE rtrim(split_part(split_part({strip("text")}, chr(10), 1), '. ', 1), '.') || '. [1]' END AS answer, coalesce(first, '') AS cited
      FROM asked LEFT JOIN contexts USING (query_id) LEFT JOIN latest ON chunk_id = first""",
    "answers_checked": rf"""{FOUND}, {PASSED}, a AS (SELECT split_part(split_part({strip("text")}, chr(10), 1), '. ', 1) AS answer, text FROM contexts JOIN latest ON chunk_id = first),
      j AS (SELECT coalesce(list_bool_and(list_transform(regexp_extract_all(regexp_replace(answer, '\[\d+\]', '', 'g'), '\d+'), lambda n: contains(text, n))), true) AS ok FROM a)
      SELECT count(*) AS judged, count(*) FILTER (NOT ok) AS flagged, count(*) FILTER (NOT ok) / count(*)::DOUBLE AS rate FROM j""",
    "loaded_files": f"""WITH h AS (SELECT *, CASE metadata.file_type WHEN 'txt' THEN 'txt' WHEN 'md' THEN 'xyz' ELSE 'TXT' END AS suffix FROM docs),
      i AS (SELECT doc_id AS stem, suffix, content, regexp_extract_all(hex(encode(content)), '..') AS x FROM h)
      SELECT sha256(unhex(hex(encode(stem || '.' || suffix || '::')) || array_to_string(list_transform(x, lambda b: CASE WHEN b < '8' THEN b WHEN b < 'C' THEN 'C2' || b ELSE 'C3' || translate(b[1], 'CDEF', '89AB') || b[2] END), ''))) AS doc_id,
        stem || '.' || suffix AS source_file, CASE WHEN suffix <> 'xyz' THEN 'txt' END AS file_type,
        CASE WHEN suffix = 'xyz' OR {strip("content")} = '' THEN 'failed' ELSE 'loaded' END AS status,
        CASE WHEN suffix = 'xyz' THEN 'unsupported type: .xyz' WHEN {strip("content")} = '' THEN 'empty' END AS reason,
        CASE WHEN suffix <> 'xyz' AND {strip("content")} <> '' THEN content END AS content FROM i""",
    "article_filter": rf"""WITH t AS (SELECT doc_id, metadata.custom['title'] AS title, content FROM docs)
      SELECT doc_id AS id, 'Title: ' || title || chr(10) || chr(10) || content AS article FROM t WHERE {strip("content")} <> '' AND regexp_matches(title, '(?i)\b(?:{KEYWORDS})s?\b')""",
    "question_cleanup": f"""SELECT DISTINCT trace_id, regexp_replace(regexp_replace({strip("'\"' || query || '\" '")}, '^\"+|\"+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS question FROM traces WHERE query IS NOT NULL""",
    "hash_sample_docs": "SELECT doc_id, sha256('42:' || doc_id) AS place FROM docs WHERE contains(metadata.source_file, 'wiki_') ORDER BY place LIMIT 30",
    "trace_rollup": f"""WITH {LATEST_TRACES} SELECT lower({strip("query")}) AS query, count(*) AS runs, count(*) FILTER (NOT success) AS failures, round(avg(duration_ms) FILTER (duration_ms >= 0), 9) AS mean_ms,
      count(*) FILTER (CASE WHEN json_valid(stages) THEN json_extract_string(stages, '$.cache.hit') END = 'true') AS cache_hits FROM newest GROUP BY 1""",
    "trace_stages": f"WITH {LATEST_TRACES} SELECT stage, count(*) AS traces FROM (SELECT unnest(json_keys(stages)) AS stage FROM newest WHERE json_valid(stages)) GROUP BY stage",
    "chunk_vectors": f"""WITH {LATEST_CHUNKS}, v AS (SELECT chunk_id, parent_doc_id, chunk_index, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM latest WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      f AS (SELECT parent_doc_id, arg_min(e, chunk_index) AS first FROM v GROUP BY ALL)
      SELECT chunk_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS length, round(list_cosine_similarity(e, first), 5) AS cosine FROM v JOIN f USING (parent_doc_id)""",
    "index_postings": f"WITH {LATEST_CHUNKS} SELECT t AS term, count(DISTINCT chunk_id) AS texts, count(*) AS occurrences FROM (SELECT chunk_id, unnest({terms('text')}) AS t FROM latest) GROUP BY t",
}
