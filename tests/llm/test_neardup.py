import random
import re
from itertools import combinations

import pytest

from corpuskiln.llm import neardup, queries


def shingles(text, words):
    w = [x for x in re.split("[ \t\r\n]+", text.lower()) if x]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def test_masks_cover_every_two_places():
    for gone in combinations(range(neardup.PLACES), 2):
        assert any(not set(gone) & set(m) for m in neardup.MASKS)


def test_hashes_are_exact_sets():
    texts = ["A b  c\nd a b c", "", None, "x", "é É ß ẞ 日本   a"]
    s, at = neardup.shingle_sets(texts, 3)
    assert [int(at[k + 1] - at[k]) for k in range(len(texts))] == [len(shingles(t or "", 3)) for t in texts]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    out = []
    for k in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        out.append((f"b{k}", " ".join(base)))
        for j in range(rng.randint(0, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            if j == 3:
                edited = edited[len(edited) // 2 :] + edited[: len(edited) // 2]
            out.append((f"b{k}-{j}", " ".join(edited).upper() if j == 2 else " ".join(edited)))
    return out + [("short", "a b c"), ("copy1", out[0][1]), ("copy2", out[0][1] + " ")]


def test_pairs_against_all_pairs(spark, corpus):
    sets = {i: shingles(t, 3) for i, t in corpus}
    want = {
        ("doc", *sorted((a, b)))
        for a, b in combinations([i for i in sets if len(sets[i]) >= 30], 2)
        if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])
    }
    items = spark.createDataFrame([("doc", i, t, 1) for i, t in corpus] + [("doc", None, "x y z", 1), ("doc", "n", None, 1), ("doc", "e", "", 1), ("doc", *corpus[1], 2), ("chunk", "b0", corpus[0][1], 1)], "kind string, id string, text string, cls int")
    members, links = neardup.near_duplicates(items, 3, 0.7, 30)
    got = {tuple(r) for r in neardup.expanded_pairs(members, links).collect()}
    assert got == want and len(want) > 100
    groups = {r["id"]: r["group_id"] for r in neardup.grouped(members, links).filter("kind = 'doc'").collect()}
    assert all(groups[a] == groups[b] for _, a, b in want)
    assert len(set(groups.values())) >= 120 and groups["copy1"] == groups["copy2"]


def test_copies_are_not_expanded(spark):
    text = " ".join(map(str, range(50)))
    items = spark.createDataFrame([("d", str(k), text) for k in range(200)], "kind string, id string, text string")
    members, links = neardup.near_duplicates(items)
    assert members.count() == 200 and links.count() == 0 and members.select("cls").distinct().count() == 1


def test_empty(spark):
    items = spark.createDataFrame([], "kind string, id string, text string")
    members, links = neardup.near_duplicates(items)
    assert members.count() == 0 and neardup.grouped(members, links).count() == 0 and neardup.expanded_pairs(members, links).count() == 0


def test_every_item_has_a_group(spark):
    long = "one two three four five six seven"
    rows = [("doc", "a", long), ("doc", "b", long), ("doc", "c", "Short text"), ("doc", "d", " short\ttext\n"), ("doc", "e", "other text"), ("doc", "f", ""), ("doc", "g", None), ("doc", "h", " \n"), ("doc", "c", "Short text"), ("chunk", "a", None), ("doc", None, "x")]
    items = spark.createDataFrame(rows, "kind string, id string, text string")
    got = [tuple(r) for r in neardup.with_short(items, neardup.grouped(*neardup.near_duplicates(items))).collect()]
    groups = {(k, i): g for k, i, g, _ in got}
    assert len(got) == len(groups) == 9 and {n for *_, n in got} == {0}
    assert groups["doc", "a"] == groups["doc", "b"] and groups["doc", "c"] == groups["doc", "d"]
    assert len({groups["doc", x] for x in "acefgh"}) == 6


def test_query_has_every_id(spark, sf):
    got = queries.p2_groups(spark, sf)
    want = queries._texts(spark, sf).select("kind", "id").distinct()
    assert got.count() == got.select("kind", "id").distinct().count() == want.count() and got.join(want, ["kind", "id"], "left_anti").isEmpty()


def linked(spark, rows, **kw):
    items = spark.createDataFrame(rows, "kind string, id string, text string").coalesce(1)
    return sorted(round(r["similarity"], 3) for r in neardup.near_duplicates(items, **kw)[1].collect())


def test_one_id_with_two_texts(spark):
    """Links do not depend on the order of the rows of an id that has two texts."""
    base = [f"w{k}" for k in range(300)]
    rows = [("d", "x", " ".join(base)), ("d", "x", "quite " + " ".join(f"v{k}" for k in range(100))), ("d", "y", " ".join(base[:-3]))]
    assert linked(spark, rows) == linked(spark, rows[::-1]) == [0.99]


def test_hot_bucket(spark):
    """Half of all texts share most buckets; blocks of few rows lose no pair."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(60):
        edited = list(base)
        for _ in range(3):
            edited[rng.randrange(len(edited))] = f"x{k}-{rng.random()}"
        texts.append((f"h{k:02}", " ".join(edited)))
    texts += [(f"o{k:02}", " ".join(f"z{rng.randrange(9999)}" for _ in range(100))) for k in range(60)]
    sets = {i: shingles(t, 5) for i, t in texts}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    items = spark.createDataFrame([("doc", i, t) for i, t in texts], "kind string, id string, text string")
    for hot in (7, 4096):
        got = {(r["id_a"], r["id_b"]) for r in neardup.expanded_pairs(*neardup.near_duplicates(items, hot_rows=hot)).collect()}
        assert got == want and len(want) > 1000


def test_default_measure_on_documents(spark):
    """Five words and 0.8: no link between texts of the collection is lost."""
    items = queries._texts(spark, "/root/testdata/sf0.01").filter("kind = 'doc' and length(text) < 6000")
    sets = {r["id"]: shingles(r["text"], 5) for r in items.collect() if r["text"]}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    common = {}
    for ids in by.values():
        for p in combinations(sorted(ids), 2):
            common[p] = common.get(p, 0) + 1
    want = {p for p, n in common.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    got = {(r["id_a"], r["id_b"]) for r in neardup.expanded_pairs(*neardup.near_duplicates(items)).collect()}
    assert got == want and len(want) >= 10
