"""Evaluation of retrieval, of the evidence gate and of answers; sweeps over thresholds and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions.scores import weighted
from corpuskiln.functions.text import is_refusal, strip, verdict_is_none
from corpuskiln.operators.confidence import parts


def recall_at(reranked: DataFrame, targets: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(k, hits, entries, recall): targets (query_id, source_doc_id) with a hit of the right parent within rank k.

    ``reranked`` has query_id, parent_doc_id and rank. Recall is 0 without entries.
    """
    spark = reranked.sparkSession
    found = (
        targets.select("query_id", "source_doc_id")
        .join(reranked.select("query_id", "parent_doc_id", "rank"), "query_id", "left")
        .groupBy("query_id", "source_doc_id")
        .agg(F.min(F.when(F.col("parent_doc_id") == F.col("source_doc_id"), F.col("rank"))).alias("first"))
    )
    ks = spark.createDataFrame([(k,) for k in cutoffs], "k int")
    return (
        ks.join(found, F.lit(True), "left")
        .groupBy("k")
        .agg(F.count_if(F.col("first") <= F.col("k")).alias("hits"), F.count("query_id").alias("entries"))
        .withColumn("recall", F.when(F.col("entries") > 0, F.col("hits") / F.col("entries")).otherwise(F.lit(0.0)))
    )


def best_confidence(queries: DataFrame, scored: DataFrame) -> DataFrame:
    """(query_id, label, best): the highest confidence of each query, null if nothing was found."""
    best = scored.groupBy("query_id").agg(F.max("confidence_score").alias("best"))
    return queries.select("query_id", "label").join(best, "query_id", "left")


def best_chunks(scored: DataFrame) -> DataFrame:
    """The most confident chunk of each query with its sub-scores; the first by rank of equal ones."""
    key = F.struct(F.col("confidence_score"), (-F.col("rank")).alias("first"))
    return scored.groupBy("query_id").agg(F.max_by(F.struct("id", "confidence_score", "freshness", "trust", "overlap", "relevance"), key).alias("b")).select("query_id", "b.*")


def threshold_sweep(best: DataFrame, thresholds: tuple[float, ...] = config.SWEEP_THRESHOLDS) -> DataFrame:
    """(threshold, genuine_passed, adversarial_gated) of genuine and adversarial queries (label, best)."""
    steps = best.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return (
        best.join(F.broadcast(steps))
        .groupBy("threshold")
        .agg(
            F.count_if((F.col("label") == "genuine") & (F.col("best") >= F.col("threshold"))).alias("genuine_passed"),
            F.count_if((F.col("label") == "adversarial") & (F.col("best").isNull() | (F.col("best") < F.col("threshold")))).alias("adversarial_gated"),
        )
    )


def recommended_threshold(best: DataFrame, margin: float = config.SWEEP_MARGIN, least: int = config.SWEEP_MIN_GATED) -> DataFrame:
    """One row: the threshold just below the lowest genuine score, how many adversarial ones it gates, and whether
    these are enough."""
    low = best.filter("label = 'genuine'").agg(F.greatest(F.min("best") - F.lit(margin), F.lit(0.0)).alias("threshold"))
    gated = F.count_if((F.col("label") == "adversarial") & (F.col("best").isNull() | (F.col("best") < F.col("threshold"))))
    return best.join(F.broadcast(low)).groupBy("threshold").agg(gated.alias("gated")).withColumn("accepted", F.col("gated") >= least)


def sub_scores(scored: DataFrame, as_of: Column) -> DataFrame:
    return scored.withColumns(parts(as_of, scored))


def weight_sweep(queries: DataFrame, scored: DataFrame, probe: str, schemes: dict[str, dict[str, float]] | None = None, margin: float = config.SWEEP_MARGIN) -> DataFrame:
    """(scheme, position, threshold, genuine_passed, adversarial_gated, probe_caught) per scheme of weights.

    ``scored`` has query_id and the four sub-scores, which are worked out once; ``queries`` has query_id, query and
    label. The threshold is the scheme's own recommended one; a probe (the adversarial queries that contain the
    given text) without any hit counts as caught.
    """
    schemes = schemes or config.WEIGHT_SCHEMES
    rows = [(name, k, *(float(w[p]) for p in ("freshness", "trust", "overlap", "relevance"))) for k, (name, w) in enumerate(schemes.items())]
    table = scored.sparkSession.createDataFrame(rows, "scheme string, position int, w_freshness double, w_trust double, w_overlap double, w_relevance double")
    total = sum((F.col(p) * F.col(f"w_{p}") for p in ("trust", "overlap", "relevance")), F.col("freshness") * F.col("w_freshness"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    best = (
        scored.select("query_id", "freshness", "trust", "overlap", "relevance")
        .join(F.broadcast(table))
        .groupBy("query_id", "scheme")
        .agg(F.max(confidence).alias("best"))
    )
    every = queries.select("query_id", "query", "label").join(F.broadcast(table.select("scheme", "position"))).join(best, ["query_id", "scheme"], "left")
    low = every.filter("label = 'genuine'").groupBy("scheme").agg(F.greatest(F.min("best") - F.lit(margin), F.lit(0.0)).alias("threshold"))
    missed = F.col("best").isNull() | (F.col("best") < F.col("threshold"))
    return (
        every.join(F.broadcast(low), "scheme")
        .groupBy("scheme", "position", "threshold")
        .agg(
            F.count_if((F.col("label") == "genuine") & (F.col("best") >= F.col("threshold"))).alias("genuine_passed"),
            F.count_if((F.col("label") == "adversarial") & missed).alias("adversarial_gated"),
            F.coalesce(F.bool_and(F.when((F.col("label") == "adversarial") & F.contains("query", F.lit(probe)), missed)), F.lit(False)).alias("probe_caught"),
        )
    )


def selected_scheme(sweep: DataFrame, genuine: int, selectable: tuple[str, ...] = config.SELECTABLE_SCHEMES) -> DataFrame:
    """The first selectable scheme that passes all genuine queries and catches the probe; no row if none does."""
    good = sweep.filter(F.col("scheme").isin(*selectable) & (F.col("genuine_passed") == genuine) & F.col("probe_caught"))
    return good.orderBy("position").limit(1)


def extremes(best: DataFrame, label: str, count: int, highest: bool) -> DataFrame:
    """The ``count`` queries of a label with the highest or lowest best confidence; those without any come last."""
    order = F.desc_nulls_last("best") if highest else F.asc_nulls_last("best")
    return best.filter(F.col("label") == label).orderBy(order, "query_id").limit(count)


def gate_rate(answers: DataFrame, refusal: str = config.REFUSAL) -> DataFrame:
    """One row: answers, refusals among them, and their share (0 without answers)."""
    return answers.agg(F.count("*").alias("answers"), F.count_if(is_refusal(F.col("answer"), refusal)).alias("refusals")).withColumn(
        "gate_rate", F.when(F.col("answers") > 0, F.col("refusals") / F.col("answers")).otherwise(F.lit(0.0))
    )


def judged_context(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): the text a judge gets: that of the cited chunks in order of markers, or of all context
    chunks where nothing is cited, each without outer space, blank ones left out; a fixed text if none is left.
    ``answers`` has query_id, citations and context_chunks; a cited chunk that is unknown adds nothing."""
    cited = answers.select("query_id", F.posexplode("citations").alias("at", "c")).select("query_id", "at", F.col("c.chunk_id").alias("chunk_id")).filter("chunk_id <> ''")
    from_cited = (
        cited.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
        .select("query_id", F.col("t.text").alias("cited"))
    )
    parts = F.filter(F.transform(F.coalesce("cited", "context_chunks.text"), strip), lambda t: t != "")
    context = F.array_join(parts, "\n\n")
    return answers.join(from_cited, "query_id", "left").select("query_id", F.when(context != "", context).otherwise(F.lit(config.NO_CHUNKS)).alias("context"))


def unsupported_rate(verdicts: DataFrame, refusal: str = config.REFUSAL) -> DataFrame:
    """One row: answers judged (refusals are not), flagged ones, and their share (null if none was judged)."""
    judged = verdicts.filter(~is_refusal(F.col("answer"), refusal))
    flagged = F.count_if(~verdict_is_none(F.col("verdict")))
    return judged.agg(F.count("*").alias("judged"), flagged.alias("flagged")).withColumn("rate", F.when(F.col("judged") > 0, F.col("flagged") / F.col("judged")))


def rescored(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    return scored.withColumn("confidence_score", weighted({p: F.col(p) for p in ("freshness", "trust", "overlap", "relevance")}, weights))
