"""Near-duplicate texts by covering locality-sensitive hashing.

Each text becomes the set of its word shingles and a signature of ``groups`` times seven min-wise hash
values. In each group a seven-place signature is looked up under seven structured masks of four places:
place i (a non-zero 3-bit vector) belongs to mask v exactly if <i, v> = 1 over GF(2). Two signatures that
differ in at most two places of a group agree on all places of some mask of it, whichever the places are,
so by the pigeonhole principle every pair that differs in fewer than ``3 * groups`` places collides in some
table; pairs beyond that radius mostly collide too. Colliding pairs are checked exactly on their shingle sets.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.tables import written

PLACES = 7
#: mask v covers place i if their inner product over GF(2) is odd; four places each
MASKS = [[i - 1 for i in range(1, 8) if bin(i & v).count("1") % 2] for v in range(1, 8)]
_SPACE = re.compile(r"[ \t\r\n]+")


def _mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts end to end, and where each text's begin."""
    import xxhash

    lists = [[w for w in _SPACE.split(t.lower()) if w] if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = pa.array([w for x in lists for w in x], type=pa.string()).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w.as_py().encode("utf-8", "surrogatepass")) for w in flat.dictionary], dtype=np.uint64)
    h = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, dtype=np.uint64)
    ends, counts = np.cumsum(sizes), np.maximum(sizes - words + 1, 0)
    n = len(h) - words + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    owner = np.repeat(np.arange(len(texts)), counts)
    s = s[np.repeat(ends - sizes, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)]
    order = np.lexsort((s, owner))
    owner, s = owner[order], s[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (s[1:] != s[:-1])
    return s[fresh], np.r_[0, np.cumsum(np.bincount(owner[fresh], minlength=len(texts)))]


def _pieces(batch: pa.RecordBatch, most: int = 512):
    for a in range(0, batch.num_rows, most):
        yield batch.slice(a, most)


def _sketcher(words: int, least: int, groups: int):
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 2**63, size=groups * PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(batches):
        for whole in batches:
            for batch in _pieces(whole):
                s, at = shingle_sets(batch.column("text").to_pylist(), words)
                n = np.diff(at)
                keep = np.flatnonzero(n >= max(1, least))
                if not len(keep):
                    continue
                starts = at[:-1][keep]
                inside = np.zeros(len(at) - 1, dtype=bool)
                inside[keep] = True
                s = s[np.repeat(inside, n)]
                starts = np.r_[0, np.cumsum(n[keep])][:-1]
                cls = _classes(s, starts)
                sig = np.empty((len(keep), len(factors)), dtype=np.uint32)
                for k, f in enumerate(factors):
                    sig[:, k] = np.minimum.reduceat(((s * f) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(k), starts)
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("kind").take(take),
                        batch.column("id").take(take),
                        cls,
                        pa.array(n[keep].astype(np.int32)),
                        pa.array(list(sig.view(np.int32)), type=pa.list_(pa.int32())),
                    ],
                    names=["kind", "id", "cls", "n", "sig"],
                )

    return sketch


def _classes(s: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The class of each set of shingles: 128 bits that are equal for equal sets."""
    ids = np.empty((len(starts), 2), dtype=np.uint64)
    ids[:, 0] = np.add.reduceat(_mix(s), starts)
    ids[:, 1] = np.bitwise_xor.reduceat(_mix(s + np.uint64(0x632BE59BD9B4E019)), starts)
    raw = ids.tobytes()
    return pa.array([raw[16 * j : 16 * j + 16] for j in range(len(starts))], type=pa.binary())


def _sets(words: int):
    """The shingle set of every text with its class, worked out anew: an id may have texts of several classes."""

    def sets(batches):
        for whole in batches:
            for batch in _pieces(whole):
                s, at = shingle_sets(batch.column("text").to_pylist(), words)
                keep = np.flatnonzero(np.diff(at))
                if len(keep):
                    ends = np.r_[at[keep], len(s)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("kind").take(pa.array(keep)), _classes(s, at[keep]), pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))],
                        names=["kind", "cls", "items"],
                    )

    return sets


def near_duplicates(
    items: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    least: int = 1,
    groups: int = 6,
    hot_rows: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """``members(kind, id, cls)`` and ``links(kind, cls_a, cls_b, similarity)`` of ``items(kind, id, text)``.

    Only items of one kind are compared. Texts are lower-cased and cut into words at spaces, tabs, CR and LF;
    the similarity of two texts is the Jaccard similarity of their sets of ``words`` successive words. Items
    with equal sets share a class; links join classes whose similarity is at least ``threshold``, each pair
    once, so that copies are not expanded. Texts with fewer than ``least`` shingles (at least 1), null and empty
    texts and null ids have no class. Rows repeated under one id count once; should their texts differ, the id
    belongs to the class of each. An empty table gives two empty results; other columns of ``items`` are ignored.
    A bucket of more than ``hot_rows`` classes is compared in blocks, each with each, so that no task holds it whole.
    """
    items = items.select("kind", F.col("id").cast("string").alias("id"), "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    sketches = written(
        items.mapInArrow(_sketcher(words, least, groups), "kind string, id string, cls binary, n int, sig array<int>"), "sketches"
    )
    members = sketches.select("kind", "id", "cls").distinct()
    classes = sketches.groupBy("kind", "cls").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    tables = [
        F.xxhash64(F.lit(g * PLACES + v), "kind", *[F.col("sig")[g * PLACES + i] for i in mask])
        for g in range(groups)
        for v, mask in enumerate(MASKS)
    ]
    placed = classes.select("kind", "cls", "n", F.explode(F.array(*tables)).alias("bucket"))
    shared = written(placed.groupBy("bucket").agg(F.count("*").alias("rows")).filter("rows > 1"), "buckets")
    blocks = F.ceil(F.col("rows") / hot_rows).cast("int")
    # as many buckets as the collection has: never broadcast, at any size
    buckets = placed.join(shared.hint("merge"), "bucket").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # block i meets block j >= i: a row of block k is on the left for all j >= k, on the right for all i <= k
    left = buckets.select("bucket", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), "kind", F.col("cls").alias("a"), F.col("n").alias("n_a"))
    right = buckets.select("bucket", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("kind").alias("kind_b"), F.col("cls").alias("b"), F.col("n").alias("n_b"))
    pairs = written(
        left.join(right, ["bucket", "i", "j"])
        .filter("kind = kind_b and (a < b or i < j and a <> b) and least(n_a, n_b) >= %r * greatest(n_a, n_b)" % (threshold - 1e-9))
        .select("kind", F.least("a", "b").alias("cls_a"), F.greatest("a", "b").alias("cls_b"))
        .distinct(),
        "candidates",
    )
    involved = pairs.select("kind", F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    chosen = classes.select("kind", "cls", "id").join(involved, ["kind", "cls"], "left_semi").select("kind", "id").distinct()
    sets = (
        items.join(chosen, ["kind", "id"])
        .select("kind", "text")
        .mapInArrow(_sets(words), "kind string, cls binary, items array<long>")
        .join(involved, ["kind", "cls"], "left_semi")
        .groupBy("kind", "cls").agg(F.first("items").alias("items"))  # equal for equal classes
    )
    links = (
        pairs.join(sets.select("kind", F.col("cls").alias("cls_a"), F.col("items").alias("a")), ["kind", "cls_a"])
        .join(sets.select("kind", F.col("cls").alias("cls_b"), F.col("items").alias("b")), ["kind", "cls_b"])
        .withColumn("common", F.size(F.array_intersect("a", "b")).cast("double"))
        .withColumn("similarity", F.col("common") / (F.size("a") + F.size("b") - F.col("common")))
        .filter(F.col("common") >= F.lit(threshold) * (F.size("a") + F.size("b") - F.col("common")) - 1e-9)
        .select("kind", "cls_a", "cls_b", "similarity")
    )
    return members, links


def expanded_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(item_kind, id_a, id_b) with id_a < id_b: all pairs of items that share a class or whose classes are linked."""
    a = members.withColumnsRenamed({"id": "x", "cls": "cls_a"})
    b = members.withColumnsRenamed({"id": "y", "cls": "cls_b"})
    across = links.select("kind", "cls_a", "cls_b").join(a, ["kind", "cls_a"]).join(b, ["kind", "cls_b"]).select("kind", "x", "y")
    within = (
        members.withColumnRenamed("id", "x")
        .join(members.withColumnRenamed("id", "y"), ["kind", "cls"])
        .filter("x < y")
        .select("kind", "x", "y")
    )
    return (
        across.unionByName(within)
        .filter("x <> y")
        .select(F.col("kind").alias("item_kind"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )


def with_short(items: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` with a row, of no links, for each of ``items(kind, id, text)`` that has no class: texts without
    shingles form a group by the hash of their lower-case words, null texts and texts without words one each of their own.
    Rows repeated under one id count once for each different text; null ids have no row."""
    items = items.select("kind", F.col("id").cast("string").alias("id"), "text").filter(F.col("id").isNotNull())
    words = F.filter(F.split(F.lower("text"), r"[ \t\r\n]+"), lambda w: w != "")
    named = F.when(F.size(words) > 0, F.concat(F.lit("words "), F.array_join(words, " "))).otherwise(F.concat(F.lit("none "), "id"))
    rows = items.select("kind", "id", F.upper(F.md5(named)).alias("group_id"), F.lit(0).cast("long").alias("links")).distinct()
    return groups.unionByName(rows.join(groups.select("kind", "id"), ["kind", "id"], "left_anti"))


def grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, group_id, links): the connected group of every item, named by its least class, and the
    number of classes its own is linked to. Labels move along links and jump through their own labels, each
    round written out, until no label changes."""
    edges = written(
        links.select("kind", F.col("cls_a").alias("cls"), F.col("cls_b").alias("near"))
        .unionByName(links.select("kind", F.col("cls_b").alias("cls"), F.col("cls_a").alias("near"))),
        "edges",
    )
    label = edges.select("kind", "cls").distinct().withColumn("label", F.col("cls"))
    while True:
        best = edges.join(label.select("kind", F.col("cls").alias("near"), F.col("label").alias("its")), ["kind", "near"]).groupBy("kind", "cls").agg(F.min("its").alias("its"))
        moved = label.join(best, ["kind", "cls"]).select("kind", "cls", "label", F.least("label", "its").alias("next"))
        jump = moved.select("kind", F.col("cls").alias("next"), F.col("next").alias("beyond"))
        new = written(
            moved.join(jump, ["kind", "next"], "left").select("kind", "cls", "label", F.coalesce("beyond", "next").alias("next")), "labels"
        )
        label = new.select("kind", "cls", F.col("next").alias("label"))
        if new.filter("label <> next").isEmpty():
            break
    degree = edges.groupBy("kind", "cls").agg(F.count("*").alias("links"))
    return (
        members.join(label, ["kind", "cls"], "left")
        .join(degree, ["kind", "cls"], "left")
        .select("kind", "id", F.hex(F.coalesce("label", "cls")).alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
