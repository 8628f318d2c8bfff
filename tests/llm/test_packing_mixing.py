from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskiln.llm import mixing, packing

SCHEMA = "doc_id bigint, text string, source string"


def best_padding(histogram, buckets):
    """Least padding over all choices of bounds, by trying them."""
    capacity = len(histogram) - 1
    lengths = [n for n in range(1, capacity + 1) if histogram[n]]

    def cost(i, j):
        u = lengths[j - 1]
        return sum(histogram[n] * (capacity / (capacity // u) - n) for n in lengths[i:j])

    def best(j, b):
        if j == 0:
            return 0.0
        return min((best(i, b - 1) + cost(i, j) for i in range(j)), default=float("inf")) if b else float("inf")

    return best(len(lengths), buckets)


def padding(histogram, bounds):
    capacity = len(histogram) - 1
    return sum(histogram[n] * (capacity / (capacity // min(b for b in bounds if b >= n)) - n) for n in range(1, capacity + 1) if histogram[n])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=9, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(counts, buckets):
    histogram = np.array([0, *counts])
    bounds = packing.bucket_bounds(histogram, buckets)
    if not histogram.any():
        assert bounds == []
    else:
        assert len(bounds) <= buckets and padding(histogram, bounds) == pytest.approx(best_padding(histogram, buckets))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_containers_hold(lengths):
    lengths = np.array(lengths)
    bounds = packing.bucket_bounds(np.bincount(lengths, minlength=51), 4)
    number = packing.fill(lengths, 50, bounds)
    used = np.bincount(number, weights=lengths)
    assert number.min() >= 0 and used.max() <= 50 and used.min() > 0
    assert len(used) <= 2 * -(-lengths.sum() // 50)


def test_fill_operator(spark):
    rows = [(1, "word " * 30, "a"), (2, "word", "a"), (3, "", "a"), (4, None, "a"), (5, "word " * 7, "b"), (5, "word " * 7, "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.fill_containers(df, "doc_id", "text", 12).collect()
    by = defaultdict(int)
    for r in got:
        if r["container"]:
            by[r["container"]] += r["tokens"]
    assert max(by.values()) <= 12 and all(by[r["container"]] == r["used"] for r in got if r["container"])
    first = sorted((r["first_token"], r["tokens"]) for r in got if r["id"] == 1)
    assert [a for a, _ in first] == [0, 12, 24] and sum(n for _, n in first) >= 30
    assert {r["id"] for r in got if r["container"] is None} == {3, 4} and sum(r["id"] == 5 for r in got) == 2
    report = packing.fill_report(packing.fill_containers(df, "doc_id", "text", 12), 12).first()
    assert report["fullest"] == 12 and report["tokens"] == sum(by.values())
    empty = packing.fill_containers(df.limit(0), "doc_id", "text", 12)
    assert empty.count() == 0 and packing.fill_report(empty, 12).first()["filled"] is None
    with pytest.raises(ValueError):
        packing.fill_containers(df, "doc_id", "text", 0)


def test_cut_time():
    assert mixing.cut_time([(0.5, 100), (0.5, 100)], 100) == 100
    assert mixing.cut_time([(0.5, 10), (0.5, 100)], 60) == 100  # the first runs out
    assert mixing.cut_time([(0.5, 10)], 60) == float("inf") and mixing.cut_time([], 5) == float("inf")


def test_mixture(spark):
    rows = [(k, "some words in a text", " BIG ") for k in range(2000)] + [(10_000 + k, "some words in a text", "small") for k in range(100)] + [(20_000, None, "big"), (20_001, "", "big"), (20_002, "x", None), (20_003, "x", "other")]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("big", 0.6, 1), ("Small", 0.3, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixture = mixing.mix_sources(df, targets, budget=1000)
    got = {r["source"]: r for r in mixing.mix_report(mixture, targets).collect()}
    assert got["big"]["share"] == pytest.approx(2 / 3, abs=0.02) and got["small"]["share"] == pytest.approx(1 / 3, abs=0.02)
    assert got["absent"]["tokens"] == 0 and 990 <= got["big"]["tokens"] + got["small"]["tokens"] <= 1000
    whole = mixing.mix_sources(df, targets)  # the small source runs out after three copies
    rows = whole.collect()
    assert max(r["copy"] for r in rows if r["source"] == "small") == 3 and {r["copy"] for r in rows if r["source"] == "big"} == {1}
    assert [r["virtual_finish"] for r in rows] == sorted(r["virtual_finish"] for r in rows)
    assert len({(r["id"], r["copy"]) for r in rows}) == len(rows)
    assert mixing.mix_sources(df.limit(0), targets).count() == 0 and mixing.mix_sources(df, targets.limit(0)).count() == 0


def test_bounds_decide_containers():
    lengths = np.array([6, 5, 5, 4])
    one, two = (packing.fill(lengths, 16, bounds).tolist() for bounds in ([4, 6], [16]))
    assert one == [0, 0, 1, 0]  # two of the bucket of 6, then the longest of the shorter one
    assert two == [0, 0, 0, 1]  # one bucket


def test_bounds_of_large_capacities_are_few_steps():
    rng = np.random.default_rng(3)
    histogram = np.bincount(rng.integers(1, 100_000, 5000), minlength=131_073)
    bounds = packing.bucket_bounds(histogram, 8, steps=256)
    assert 1 < len(bounds) <= 8 and bounds[-1] >= np.flatnonzero(histogram)[-1] and all(b % 512 == 0 for b in bounds)


def test_single_bucket_is_best_fit():
    assert packing.filled_in_order(np.array([6, 5, 5, 4]), 16) == 2 and packing.filled_in_order(np.array([], dtype=int), 16) == 0
