import numpy as np
import pytest

from corpuskiln.llm import boilerplate, mojibake, residue
from corpuskiln.tables import read


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, "/root/testdata/sf0.01", "docs").select("doc_id", "content", "metadata.file_type")


@pytest.mark.parametrize("pair", mojibake.PAIRS)
def test_round_trip(pair):
    text = "ж" if pair[0] in ("cp1251", "koi8-r", "cp866") else "日本" if pair[0] in ("shift_jis", "euc_jp") else "é"
    assert mojibake.restore(mojibake.garble(text, pair), pair) == text


def test_restores_what_was_garbled(spark, docs):
    """Clean documents of the collection garbled on purpose are found and put right; as they are, they are left alone."""
    texts = [r["content"] for r in docs.filter("length(content) between 300 and 4000").orderBy("doc_id").limit(500).collect()]
    model = mojibake.train([t for t in texts if not t.isascii()])
    clean = [t for t in texts if not t.isascii() and not mojibake.examine(t, model)[0]][:150]
    assert len(clean) > 100
    for pair in mojibake.PAIRS[:3] + mojibake.PAIRS[4:7]:
        spoiled = [mojibake.garble(t, pair) for t in clean]
        results = [mojibake.examine(t, model) for t in spoiled]
        assert sum(r[0] > 0 for r in results) >= 0.97 * len(clean), pair
        assert sum(r[2] == t for r, t in zip(results, clean)) >= 0.85 * len(clean), pair


def test_examples_are_no_cases(spark, docs):
    rows = [("a", "When UTF-8 bytes are read as Latin-1, the letter é turns into Ã© here."), ("b", "La mÃ©thode gÃ©nÃ©rale a Ã©tÃ© rÃ©pÃ©tÃ©e."), ("c", ""), ("d", None), ("e", "plain"), ("f", "U+FFFD (�) for each bad byte"), ("g", "z�hlt die Werte")]
    df = docs.selectExpr("doc_id as id", "content as text").unionByName(spark.createDataFrame(rows, "id string, text string")).withColumnRenamed("id", "seen")
    out = mojibake.restore_encoding(df, "seen", "text").filter("length(id) = 1").collect()
    got = {r["id"]: r for r in out}
    assert {k for k, r in got.items() if r["garbled"]} == {"b", "g"} and got["g"]["lost"] == 1
    assert got["b"]["restored"] == "La méthode générale a été répétée." and got["d"]["restored"] is None and got["c"]["restored"] == ""
    assert mojibake.restore_encoding(df.limit(0), "seen", "text").count() == 0


PAGE = """Heap sort | Site
Skip to content
Home » Docs » Heap sort
We use cookies to improve our service and balance traffic.
Heap sort
3 min read
History
Researchers found that the sorted heap rarely exceeds the larger of both arrays in most builds of it.
Leave a comment
Table
12 rows
In 1964, the first group replaced the list with a balanced heap that keeps every entry in its place.
Topics: heap #sort
You may also like
Merge sort
bob12 says
Great write-up.
© 2020 Site. All rights reserved."""


def test_main_body(spark, docs):
    pages = docs.filter("file_type = 'html'").selectExpr("doc_id as id", "content as text")
    extra = spark.createDataFrame([("p", PAGE), ("q", ""), ("r", None), ("s", "only\nmenu")], "id string, text string")
    df = pages.unionByName(extra).withColumnRenamed("text", "body")
    got = {r["id"]: r for r in boilerplate.main_bodies(df, "id", "body").filter("length(id) = 1").collect()}
    lines = PAGE.split("\n")
    assert got["p"]["body"].split("\n") == [lines[k] for k in (4, 6, 7, 9, 10, 11)]
    assert got["p"]["outside"] == [1, 2, 3, 5, 8, 12, 13, 14, 15, 16, 17]
    assert got["q"]["body"] == got["r"]["body"] == "" and got["r"]["outside"] == [] and got["s"]["outside"] in ([1], [])
    assert boilerplate.main_bodies(df.limit(0), "id", "body").count() == 0


CASES = {
    "Hello {{ name }}, welcome.": "slot", "Version [INSERT VERSION HERE] of the tool": "slot", "Widget: undefined\nPrice: NaN": "value", "Lorem ipsum dolor elit semper corpo gravid.": "filler",
    "TODO: write this section": "filler", "A real start of text.\n404 Not Found": "message", "Seite nicht gefunden": "message", "Please enable JavaScript to continue.": "scripts",
    'A message such as "access denied" or "page not found" is logged once per run by it.': None, "The page needs JavaScript; if users disable JavaScript, the hash batches a cipher instead.": None,
    "The server returns 503 Service Unavailable while the log scans pages.": None, "Its stack traces the batch gradually and in full.": None, "An ordinary text about heaps.": None,
}


def test_residue_cases(spark):
    rows = [(k, t) for k, t in enumerate(CASES)] + [(90, ""), (91, None), (92, next(iter(CASES)))]
    rows += [(100 + k, f"In {n}, the mark {{{{thing}}}} of old {n} files stands before the {w} of every new record.") for k, (n, w) in enumerate(zip(["Aba", "Bob", "Cid", "Dan", "Eve", "Fay"], ["heap", "tree", "list", "ring", "map", "log"]))]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumnRenamed("id", "kind")
    got = {r["id"]: r["kind"] for r in residue.find_residue(df, "kind", "text").collect()}
    assert [got[k] for k in range(len(CASES))] == list(CASES.values())
    assert got[90] is None and got[91] is None and got[92] == "slot" and len(got) == len(rows)
    assert {got[100 + k] for k in range(6)} == {None}  # the same mark in the same place of sentences that differ
    assert residue.find_residue(df.limit(0), "kind", "text").count() == 0


def test_long_runs_and_many_rounds(spark, docs):
    """Runs of any length are widened whole, and a mistake made three times is undone."""
    texts = [r["content"] for r in docs.filter("length(content) between 300 and 4000").orderBy("doc_id").limit(500).collect()]
    model = mojibake.train([t for t in texts if not t.isascii()])
    word = "é" * 100
    once = mojibake.garble(word, ("utf-8", "latin-1"))
    assert mojibake._run_begin("a" + once, len(once), 0) == 1 and mojibake._run_end(once, 3) == len(once)
    text = "Le mémoire partagée de la clé privée reçoit déjà une requête répétée."
    spoiled = text
    for _ in range(3):
        spoiled = mojibake.garble(spoiled, ("utf-8", "cp1252"))
    assert mojibake.examine(spoiled, model)[2] == text


def test_model_of_all_texts(spark, docs):
    """The model counts every text, however many and long: here of signs that only one long text has right."""
    words = "ქარი ბარდნის ზღვაში და ცაში "
    rows = [("long", words * 1000), ("bad", "Title: " + mojibake.garble(words, ("utf-8", "cp1252")))]
    df = docs.selectExpr("doc_id as id", "content as text").unionByName(spark.createDataFrame(rows, "id string, text string"))
    got = {r["id"]: r for r in mojibake.restore_encoding(df, "id", "text").filter("id in ('long', 'bad')").collect()}
    assert got["long"]["garbled"] == 0 and got["bad"]["garbled"] > 0 and got["bad"]["restored"] == "Title: " + words
    texts = [r["text"] for r in df.collect() if r["text"] and not (r["text"].isascii() and "&" not in r["text"])]
    one, all_ = mojibake.train(texts), mojibake.train_on(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    assert one.proper == all_.proper and (one.keys == all_.keys).all() and (one.both == all_.both).all()


def test_paths_only_where_they_pay(docs, monkeypatch):
    """Few clean texts get as far as a search for states, and texts looked at together give what each gives alone."""
    texts = [r["content"] for r in docs.filter("length(content) between 300 and 4000").orderBy("doc_id").limit(500).collect()]
    model = mojibake.train([t for t in texts if not t.isascii()])
    clean = [t for t in texts if not t.isascii() and not mojibake.examine(t, model)[0]]
    path, sought = mojibake._path, []
    monkeypatch.setattr(mojibake, "_path", lambda r, cost: sought.append(len(r)) or path(r, cost))
    searched = 0
    for t in clean:
        sought.clear()
        assert mojibake.examine(t, model)[0] == 0
        searched += bool(sought)
    assert searched <= 0.1 * len(clean)
    mixed = [x for t in clean[:60] for x in (t, "", mojibake.garble(t, ("utf-8", "cp1252")), "&Atilde;&copy;t" + t, t + "\ufffd")]
    assert list(mojibake.examine_all(mixed, model)) == [mojibake.examine(t, model) for t in mixed]


def _most_likely(r):
    """The score of the best labelling, by the plain recursion over all states."""
    clean, pair = 0.0, np.full(r.shape[1], -np.inf)
    for row in r.astype(float):
        clean, pair = max(clean, pair.max() - mojibake.LEAVE), np.maximum(pair, clean - mojibake.ENTER) + row
    return max(clean, pair.max() - mojibake.LEAVE)


def test_labels_are_the_most_likely():
    rng = np.random.default_rng(4)
    found = 0
    for _ in range(400):
        n = int(rng.integers(1, 90))
        r = rng.normal(rng.choice([-2, -0.5, 0, 0.3]), rng.choice([0.5, 2, 4]), (n, len(mojibake.PAIRS))).astype(np.float32)
        labels = mojibake._labels(r, np.ones(len(mojibake.PAIRS), dtype=bool))
        score, before = 0.0, -1
        for t, k in enumerate(labels):
            score += (k != before) * ((before >= 0) * -mojibake.LEAVE - (k >= 0) * mojibake.ENTER[k]) + (k >= 0) * float(r[t, k])
            before = k
        score -= (before >= 0) * mojibake.LEAVE
        assert abs(score - _most_likely(r)) < 1e-3
        found += (labels >= 0).any()
    assert 50 < found < 400
