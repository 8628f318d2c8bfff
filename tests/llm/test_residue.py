from re import _parser

import pytest

from corpuskiln.llm import residue

def found(text):
    return any(residue.hits(u) for u in residue.units(text))


def kinds(spark, texts):
    rows = residue.find_residue(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").collect()
    return [r["kind"] for r in sorted(rows)]


def example(tree, k):
    """A text of a parsed pattern; ``k`` chooses among branches."""
    out = ""
    for op, av in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(av)
        elif name == "SUBPATTERN":
            out += example(av[-1], k)
        elif name == "BRANCH":
            out += example(av[1][k % len(av[1])], k)
        elif name.endswith("_REPEAT"):
            out += example(av[2], k) * max(av[0], min(av[1], k % 2))
        elif name == "IN":
            out += next((chr(v) if str(o) == "LITERAL" else chr(v[0]) if str(o) == "RANGE" else {"CATEGORY_DIGIT": "4", "CATEGORY_WORD": "w", "CATEGORY_SPACE": " "}.get(str(v), "-")) for o, v in av if str(o) != "NEGATE") if str(av[0][0]) != "NEGATE" else "-"
        elif name in ("ANY", "NOT_LITERAL"):
            out += "-"
    return out


def test_prefilter_agrees_with_all_patterns():
    """One example of every branch of every alternative is found through the prefilter."""
    tried = set()
    for n, (kind, pattern, needed) in enumerate(residue.phrases()):
        for k in range(40):
            text = example(_parser.parse(pattern.pattern, pattern.flags), k)
            if pattern.search(text):
                tried.add(n)
                assert needed is None or any(w in text.lower() for w in needed), (pattern.pattern, text)
                for u in (text, text.upper(), text.title()):
                    whole = any(p.search(x) for x in residue.units(u) for _, p in residue.KINDS)
                    assert not whole or found(u), u
    assert len(tried) >= 0.95 * len(residue.phrases())
    joined = ["|".join(residue.alternatives(p.pattern)) == p.pattern for _, p in residue.KINDS]
    assert all(joined)


@pytest.mark.parametrize("text", ["Page removed", "Page moved", "Page deleted", "This page moved", "Status 500", "Status:500", "size = nil", "Price: nil", "count=null", "x=None", "Total: $NaN", "(NaN)", "WIP: parts", "(TODO)", "**TODO**"])
def test_short_forms(text):
    assert found(text) and any(p.search(text) for _, p in residue.KINDS)


def word(k):
    return "".join(chr(97 + k // 26**i % 26) for i in range(4))


@pytest.mark.parametrize("mark", ["«THING»", "&lt;thing&gt;", "TKTK", "____"])
def test_constants_of_every_form(spark, mark):
    """Sentences that differ elsewhere and have the same mark in the same place write about it, however it is spelled."""
    rows = [(k, f"In {n}, the mark {mark} of old {n} files stands before the {w} of every new record.") for k, (n, w) in enumerate(zip(["Aba", "Bob", "Cid", "Dan", "Eve", "Fay"], ["heap", "tree", "list", "ring", "map", "log"]))]
    got = residue.find_residue(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()
    assert len(got) == 6 and {r["kind"] for r in got} == {None}


def test_constants_without_limit(spark):
    rows = [(k, "\n".join(f"The old {w} has mark {word(n)} {{{{thing}}}} here before each of its new records." for n in range(20_050))) for k, w in enumerate(["heap", "tree", "list", "ring", "map"])]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(5, "id")
    assert {r["kind"] for r in residue.find_residue(df, "id", "text").collect()} == {None}


NAMES = ["Anna", "Bert", "Carla", "Dora", "Emil", "Frida", "Gerd", "Hanna"]
DAYS = ["Monday", "Tuesday", "Friday"]


def test_slots_of_unlisted_spelling(spark):
    """Marks are found by what other records of their template have in their place, however they are spelled."""
    full = [f"Dear {n}, your parcel ships on {d}.\nIt holds {word(7 * k + j)}." for k, n in enumerate(NAMES) for j, d in enumerate(DAYS)] + [f"Bonjour {n}, votre colis part demain.\nVoir {word(k)}." for k, n in enumerate(NAMES)]
    left = ["Dear [Recipient], your parcel ships on [DeliveryDay].", "Bonjour {Prenom}, votre colis part demain.", "Dear [% who %], your parcel ships on #DAY#.", "Dear ~name~, your parcel ships on Friday.", "Dear first_name, your parcel ships on Friday."]
    got = kinds(spark, full + left)
    assert got == [None] * len(full) + ["slot"] * len(left)


def test_blank_slot(spark):
    full = [f"Dear customer {n}, your parcel ships on {d}.\nIt holds {word(7 * k + j)} and {word(11 * k + j)}." for k, n in enumerate(NAMES) for j, d in enumerate(DAYS)]
    assert kinds(spark, [*full, "Dear customer , your parcel ships on Friday."]) == [None] * len(full) + ["slot"]


def test_loose_typesetting_is_no_gap(spark):
    """A space before a comma is no slot where other records have nothing there either."""
    full = [f"Dear customer, your parcel {word(5 * k)} ships on {d}.\nIt holds {word(7 * k + j)} and {word(11 * k + j)}." for k in range(8) for j, d in enumerate(DAYS)]
    loose = "Dear customer , your parcel ships on Friday with much else in it."
    assert kinds(spark, [*full, loose]) == [None] * (len(full) + 1)


def test_repeated_pages_of_unlisted_wording(spark):
    """Lines of pages that are nothing but template are residue, also after a real beginning; lines of varied texts are not."""
    words = ["heap", "tree", "list", "ring", "map", "log", "file", "lock"]
    real = [f"A {a} may hold one {b} at a time. In 1990 the group of {n} built it." for a, n in zip(words, NAMES) for b in words if a != b]
    page = [f"This app can't start until client-side code is permitted.\n{word(7 * k).title()} | Menu" for k in range(8)]
    late = ["A heap may hold one small tree.\nThis app can't start until client-side code is permitted."]
    assert kinds(spark, real + page + late) == [None] * len(real) + ["page"] * (len(page) + 1)


def test_marks_of_a_running_template_are_its_own(spark):
    """A sentence filled differently by all its records writes about the mark that all have."""
    rows = [f"In {n}, the macro {{{{title}}}} expands to the {w} of any record." for n, w in zip(NAMES, ["heap", "tree", "list", "ring", "map", "log", "file", "lock"])]
    assert kinds(spark, rows) == [None] * len(rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (None, "404 Not Found", "d"), (5, "404 Not Found", "e"), (5, "404 Not Found", "e"), (6, "word " * 100_000, "f")], "id bigint, text string, key string")
    got = sorted(((r["id"], r["kind"]) for r in residue.find_residue(df, "id", "text").collect()), key=str)
    assert got == sorted([(1, None), (2, None), (3, None), (None, "message"), (5, "message"), (5, "message"), (6, "filler")], key=str)
    assert residue.find_residue(df.limit(0), "id", "text").count() == 0


def test_one_text_in_most_rows(spark):
    """Copies count once: no number of them makes a page."""
    df = spark.createDataFrame([(k, "A heap may hold one tree.") for k in range(3000)] + [(9000, "A list holds a ring.")], "id bigint, text string")
    assert {r["kind"] for r in residue.find_residue(df, "id", "text").collect()} == {None}
