"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source up to and including it, in shuffled
order, divided by the source's weight. Sorted by it, every prefix of the queue has the sources in their
weights as far as they last. The queue is cut where it reaches the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.llm.tokens import DEFAULT_VOCABULARY, token_count
from corpuskiln.tables import written


def _name(column):
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def cut_time(sources: list[tuple[float, float]], budget: float) -> float:
    """The virtual time at which sources of (weight, available tokens) have given ``budget`` tokens in all."""
    left = sorted((s for s in sources if s[0] > 0 and s[1] > 0), key=lambda s: s[1] / s[0])
    weight, given = sum(w for w, _ in left), 0.0
    for w, available in left:
        end = available / w
        if given + weight * end >= budget:
            return (budget - given) / weight
        given += available
        weight -= w
    return float("inf")


def sized_documents(df: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str) -> DataFrame:
    """(id, source, tokens, share, repeats) of the documents of wanted sources, written out."""
    wanted = (
        targets.select(_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
        .filter("source is not null and share > 0 and repeats > 0")
    )
    docs = df.select(F.col(id_col).alias("id"), _name(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    return written(
        docs.join(F.broadcast(wanted), "source").select("id", "source", token_count(F.col("text"), vocabulary).alias("tokens"), "share", "repeats").filter("tokens > 0"),
        "sized",
    )


def mix_sources(
    df: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    seed: int = 1,
    range_rows: int = 20_000,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """(id, source, copy, tokens, virtual_finish) of the mixture, sorted by virtual finish time.

    ``targets`` has one row per source, source, target_share and max_repeats; it must be small, as it is
    broadcast. Names of sources are compared in lower case without outer space. The budget is all tokens of the
    wanted sources, each document once, unless given. A source that runs out before the cut leaves its room to
    the others, in their weights. Copy 1 of every document of a source comes before any copy 2. Documents of other
    or null sources and texts that are null or empty take no part; rows repeated under one id count as documents.
    An empty table, or no wanted source in it, gives an empty result.
    """
    sized = sized_documents(df, targets, id_col, text_col, source_col, vocabulary)
    totals = sized.groupBy("source", "share", "repeats").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")).collect()  # a row per wanted source
    if budget is None:
        budget = sum(r["tokens"] for r in totals)
    end = cut_time([(r["share"], r["tokens"] * r["repeats"]) for r in totals], budget)

    # Only copies that begin before the cut: copy c of a source begins at (c - 1) * tokens / share.
    needed = [(r["source"], max(1, min(r["repeats"], 1 + int(end * r["share"] / r["tokens"]) if end < float("inf") else r["repeats"]))) for r in totals]
    needed = df.sparkSession.createDataFrame(needed, "source string, needed int")
    copies = sized.join(F.broadcast(needed), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("needed")))).drop("needed")
    # Running sums in two steps, so that no task needs a whole source: over ranges of about ``range_rows`` rows, then within each.
    bits = max(1, int(max((r["documents"] for r in totals), default=1) / range_rows).bit_length())
    copies = copies.withColumn("place", F.xxhash64(F.lit(seed), "copy", "id")).withColumn("range", F.shiftright("place", 64 - bits).cast("int"))
    ranges = copies.groupBy("source", "copy", "range").agg(F.sum("tokens").alias("inside"))
    before = Window.partitionBy("source").orderBy("copy", "range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0))).drop("inside")
    within = Window.partitionBy("source", "copy", "range").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    queue = (
        copies.withColumn("running", F.sum("tokens").over(within))
        .join(ranges, ["source", "copy", "range"])
        .withColumn("virtual_finish", (F.col("before") + F.col("running")) / F.col("share"))
    )
    return (
        queue.filter(F.col("virtual_finish") <= F.lit(end) * (1 + 1e-12))
        .select("id", "source", "copy", "tokens", "virtual_finish")
        .orderBy("virtual_finish", "source", "id", "copy")
    )


def mix_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, copies, tokens, share): what each wanted source really makes up."""
    got = mixture.groupBy("source", "id").agg(F.count("*").alias("copies"), F.sum("tokens").alias("tokens")).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum("tokens").alias("tokens")
    )
    got = got.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    wanted = targets.select(_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    return wanted.join(got, "source", "left").fillna(0, ["documents", "copies", "most_copies", "tokens", "share"])
