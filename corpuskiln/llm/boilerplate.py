"""The main body of web pages, by the maximum-scoring run of lines.

A page comes as text, one text node per line. Words and shapes of a line have weights from pages labelled
line by line, so that content scores above zero and each line break (a tag, once) and the words of menus,
notices and footers below; one linear scan finds the run of lines with the highest sum. Lines inside it that
score far below zero by themselves, such as advertisements between paragraphs, are outside too, and the
page's own heading above it belongs to it. The labels come from the pages' own structure (lines between
running text, and lines far from any) and from repetition: long lines that stand on many pages, but for names and
numbers, are notices, however much they look like running text. Repetition is counted over all pages. The labels
are refined with the first weights.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.mojibake import WIDE_PAIRS, restore
from corpuskiln.operators.sampling import hash_sample
from corpuskiln.tables import written

# Names under which pages list their sections.
CONTENTS = re.compile(r"^(?:table of contents|contents|on this page|in this article|inhalt(?:sverzeichnis)?|auf dieser seite|sommaire|dans cet article|índice|contenido|en esta página|conteúdo|nesta página|spis treści|содержание|目次)\s*:?$", re.I)
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_WORD_OR_ADDRESS = re.compile(r"\w[\w-]*(?:\.\w[\w-]*)+|[^\W\d_]+|\d+|[^\w\s]")
_SEPARATOR = re.compile(r"\s(?:[|»>/•·]|::|–|-)\s")
_PARTS = re.compile(r"\s+(?:[|»>/•·]|::)\s+")
_ENDS = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")
_WIDE = re.compile(r"[぀-ヿ一-鿿]")
_SENTENCES = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-z])")
_SUFFIX = re.compile(r"\s+(?:\||::|–|-|—|»|•|·)\s+.*$")


def _length(line: str) -> int:
    return len(line) + 2 * len(_WIDE.findall(line)) if not line.isascii() else len(line)


_ODD = re.compile("[ÃÂÐÑ├┬╨╤√ĂĹ]|â[€\x80-\x9f]|[РС][°-¿‚-•]")


Repeats = dict[int, tuple[int, int]]


class Line(str):
    """A line with its marks, worked out once. ``repeats`` has, by its key, how many pages have it, as a power of two in
    thousandths, and in how many tenths of these it stands before or after all running text."""

    def __new__(cls, text: str, repeats: Repeats | None = None):
        if _ODD.search(text):  # read in a wrong encoding: its words are told by what they were
            for pair in WIDE_PAIRS:
                fixed = _NOT_ASCII.sub(lambda m: restore(m[0], pair) or m[0], text)
                if len(fixed) < len(text):
                    text = fixed
        self = super().__new__(cls, text)
        self.length = _length(text)
        self.ends = bool(_ENDS.search(text[-8:]))
        self.repeats, self.outer = repeats.get(line_key(text), (0, 0)) if repeats else (0, 0)
        #: running text: a sentence of some length that few pages have
        self.running = self.length >= 60 and self.ends and self.repeats < NOTICE
        return self


#: a long line that so many pages have, as a power of two in thousandths, is a notice
NOTICE = 3


def line_key(text: str) -> int:
    """Hash of a line but for its names, addresses and numbers."""
    import xxhash

    words: list[str] = []
    each = _WORD_OR_ADDRESS.findall(text)
    for k, w in enumerate(each):
        if w[0].isdigit():
            w = "0"
        elif "." in w or w[0].isupper() and (k or len(each) > 4):
            w = "N"
        if w != "N" or not words or words[-1] != "N":
            words.append(w)
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - 2**63


def _counter(keys_of):
    """Adds up, in each task, the keys of the lines of all pages by whether they stand outside the running text."""

    def count(batches):
        for batch in batches:
            seen: Counter[tuple[int, bool]] = Counter()
            for page in batch.column("text").to_pylist():
                if page:
                    seen.update(set(keys_of(page)) | {(0, False)})
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.int64()), pa.array([o for _, o in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())],
                names=["key", "outer", "n"],
            )

    return count


def _keys(page: str) -> list[tuple[int, bool]]:
    return [(line_key(x.strip()), False) for x in page.split("\n")[1:] if x.strip()]


def _outer_keys(page: str, repeats: Repeats) -> list[tuple[int, bool]]:
    """Keys of the repeated lines of a page, but for its list of contents, and whether they are outside its running text."""
    lines = [x for _, x in page_lines(page, repeats)]
    text = [k for k in range(1, len(lines)) if lines[k].running]
    if not text:
        return []
    toc = _contents(lines)
    return [(line_key(x), not text[0] - 1 <= k <= text[-1]) for k, x in enumerate(lines) if k and x.repeats and k not in toc]


def repeated_lines(pages: DataFrame, least_share: float = 1e-3, least_pages: int = 3) -> Repeats:
    """Keys of the lines on at least ``least_share`` of all pages, and ``least_pages``: how many pages have them, as a power of two
    in thousandths, and in how many tenths of these they stand outside the running text. Both are counted over all pages;
    the result has at most as many keys as a page has lines on average, divided by the share."""
    text = pages.select("text")
    counted = written(text.mapInArrow(_counter(_keys), "key long, outer boolean, n long").groupBy("key").agg(F.sum("n").alias("n")), "lines")
    total = counted.filter("key = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = counted.filter("key <> 0").filter(F.col("n") >= max(least_pages, total * least_share)).toArrow()
    sizes = _powers(common.column("n").to_numpy(), total)
    repeats = {k: (p, 0) for k, p in zip(common.column("key").to_pylist(), sizes)}
    outside = (
        text.mapInArrow(_counter(lambda page: _outer_keys(page, repeats)), "key long, outer boolean, n long")
        .groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("outer"), F.col("n")).otherwise(0)).alias("outer"))
        .filter("key <> 0").toArrow()
    )
    for k, n, o in zip(*(outside.column(c).to_pylist() for c in ("key", "n", "outer"))):
        repeats[k] = (repeats[k][0], 10 * o // n)
    return repeats


def _powers(n: np.ndarray, total: int) -> list[int]:
    return np.maximum(1, np.floor(np.log2(1000 * n / max(total, 1))).astype(int) + 1).tolist()


def page_lines(page: str, repeats: Repeats | None = None) -> list[tuple[int, Line]]:
    return [(k, Line(x.strip(), repeats)) for k, x in enumerate(page.split("\n")) if x.strip()]


def _shapes(line: Line) -> list[str]:
    n = line.length
    out = ["~len%d" % min(9, n.bit_length())]
    if line.ends:
        out.append("~ends")
    if line[:1].islower():
        out.append("~low")
    if line[:1].isdigit():
        out.append("~digit")
    if line.repeats:
        out += ["~repeats%d" % min(line.repeats, 6), "~outer%d" % line.outer]
    if k := len(_SEPARATOR.findall(line)):
        out.append("~parts%d" % min(k, 3))
    if "," in line and not line.ends and n < 80:
        out.append("~list")
    if "#" in line:
        out.append("~hash")
    if "  " in line:
        out.append("~gaps")
    return out


class Weights:
    """Weights of words, whole short lines and shapes of a line and of its neighbours."""

    def __init__(self, common: set[str], weights: dict[str, float], repeats: Repeats):
        self.common, self.weights, self.repeats = common, weights, repeats

    def _plain(self, line: str) -> list[str]:
        out = []
        for w in _WORD.findall(line):
            low = w.lower()
            out.append("0" if w[0].isdigit() else low if low in self.common else "N" if w[0].isupper() else "n")
        return out

    def features(self, lines: list[str]) -> list[list[str]]:
        """Of the non-blank lines of a page, in order."""
        own = []
        for line in lines:
            words = self._plain(line)
            shapes = _shapes(line)
            whole = ("^" if line[:1].isupper() else "") + " ".join(words) if len(words) <= 6 else None
            own.append((words, shapes, whole))
        out = []
        for k, (words, shapes, whole) in enumerate(own):
            f = ["~bias", *shapes, *(set(words) if len(words) > 1 else ())]
            if whole is not None:
                f.append("=" + whole)
            for name, j in (("<", k - 1), (">", k + 1)):
                if 0 <= j < len(own):
                    f += [name + s for s in own[j][1]]
                else:
                    f.append(name + "edge")
            out.append(f)
        return out

    def scores(self, lines: list[str]) -> np.ndarray:
        get = self.weights.get
        return np.array([max(-6.0, min(6.0, sum(get(x, 0.0) for x in f))) for f in self.features(lines)])


def _fit(rows: list[list[str]], labels: np.ndarray, least: int = 3, steps: int = 120, shrink: float = 2.0) -> dict[str, float]:
    """Logistic regression by Adam over sparse features that occur at least ``least`` times."""
    seen: dict[str, int] = {}
    for f in rows:
        for x in f:
            seen[x] = seen.get(x, 0) + 1
    names = {x: i for i, x in enumerate(x for x, n in seen.items() if n >= least)}
    index = [[names[x] for x in f if x in names] for f in rows]
    sizes = np.array([len(x) for x in index])
    flat = np.fromiter((i for x in index for i in x), dtype=np.int64, count=int(sizes.sum()))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    row = np.repeat(np.arange(len(rows)), sizes)
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for t in range(1, steps + 1):
        z = np.add.reduceat(w[flat], starts)
        error = 1 / (1 + np.exp(-z)) - labels
        g = np.bincount(flat, weights=error[row], minlength=len(names)) + shrink * 0.05 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.12 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return {x: float(w[i]) for x, i in names.items() if abs(w[i]) > 1e-3}


def _title(lines: list[str]) -> str:
    return _SUFFIX.sub("", lines[0]).strip() if lines else ""


def _same(a: str, b: str) -> bool:
    return a == b or len(a) > 3 and a.lower() == b.lower()


def _heading(lines: list[str]) -> int | None:
    """Place of the page's heading: the line that repeats the browser title without the site's name."""
    if not lines:
        return None
    full, short = lines[0].strip(), _title(lines)
    for k in range(1, len(lines)):
        if _same(lines[k], full) or _same(lines[k], short) or len(lines[k]) > 4 and full.startswith(lines[k]) and full[len(lines[k]) :][:2] in (" |", " :", " –", " -", " ("):
            return k
    return None


def _contents(lines: list[str]) -> set[int]:
    """Lines of the page's list of its own sections."""
    out: set[int] = set()
    for k, line in enumerate(lines):
        if not CONTENTS.match(line):
            continue
        out.add(k)
        for j in range(k + 1, len(lines)):
            bare = re.sub(r"^\d+(?:\.\d+)*\.?\s+", "", lines[j])
            if lines[j].length < 80 and (bare != lines[j] or bare in lines[j + 1 :]) and not lines[j].running:
                out.add(j)
            else:
                break
    return out


def _labels(lines: list[str], scores: np.ndarray | None) -> np.ndarray:
    """1 content, 0 outside, -1 not used: by structure, and by the first weights in the second round."""
    n = len(lines)
    y = np.full(n, -1)
    text = [k for k in range(1, n) if lines[k].running]
    if not text:
        return y
    first, last = text[0], text[-1]
    top = _heading(lines)
    toc = _contents(lines)
    for k in range(1, n):
        notice = lines[k].repeats >= NOTICE and lines[k].length >= 60 and lines[k].ends
        if k in toc or notice:
            y[k] = 0
        elif k in text and (scores is None or scores[k] > -3) or k == top:
            y[k] = 1
        elif first < k < last:
            if scores is not None:
                y[k] = scores[k] > -0.5
            elif not lines[k].repeats or lines[k].outer <= 3:
                y[k] = 1
            elif lines[k].outer >= 5:
                y[k] = 0
        elif k < first - 2 or k > last + 1:
            y[k] = 0
        elif scores is not None and abs(scores[k]) > 1:
            y[k] = scores[k] > 0
    return y


def train(pages: list[str], repeats: Repeats, turns: int = 3) -> Weights:
    split = [[x for _, x in page_lines(p, repeats)] for p in pages]
    seen: dict[str, int] = {}
    for lines in split:
        for w in {w.lower() for x in lines for w in _WORD.findall(x)}:
            seen[w] = seen.get(w, 0) + 1
    least = max(3, len(pages) // 300)
    model = Weights({w for w, n in seen.items() if n >= least}, {}, repeats)
    rows = [model.features(lines) for lines in split]
    for turn in range(turns):
        labels = [_labels(lines, model.scores(lines) if turn else None) for lines in split]
        use = [(f, y) for r, ys in zip(rows, labels) for f, y in zip(r, ys) if y >= 0]
        if not use or len({y for _, y in use}) < 2:
            return model
        model.weights = _fit([f for f, _ in use], np.array([float(y) for _, y in use]))
    return model


def main_lines(page: str, model: Weights, below: float = -1.0) -> list[int]:
    """Numbers of the lines of the main body, from 0 over all lines of the page."""
    numbered = page_lines(page, model.repeats)
    if not numbered:
        return []
    at0 = numbered[0][0] == 0
    lines = [x for _, x in numbered]
    s = model.scores(lines)
    toc, top, title = _contents(lines), _heading(lines), _title(lines)
    text = [x.running for x in lines]
    for k, line in enumerate(lines):
        parts = _PARTS.split(line)
        if k in toc or len(parts) > 2 and not line.ends or len(parts) > 1 and _same(parts[-1], title):
            s[k] = min(s[k], -4.0)
        elif text[k] and s[k] > 0:
            s[k] += min(6.0, line.length / 60)  # its words count one by one
    if at0:
        s[0] = -6.0  # the browser title
    # maximum-scoring run, by one scan; a break counts at most three
    best, start, end, total, begin = 0.0, 0, 0, 0.0, 0
    for k, x in enumerate(np.maximum(s, -3.0)):
        if total <= 0:
            total, begin = 0.0, k
        total += x
        if total > best:
            best, start, end = total, begin, k + 1
    while start > 1 and below < s[start - 1] and not text[start - 1]:
        start -= 1  # a section heading may be neutral
    if top is not None and start < top < end and not any(text[start:top]):
        start = top
    inside = [k for k in range(start, end) if s[k] > below]
    if top is not None and top < start or top is not None and start <= top < end and s[top] <= below:
        inside = sorted({top, *inside})
    return [numbered[k][0] for k in inside if numbered[k][0] > 0]


def main_bodies(df: DataFrame, id_col: str, text_col: str, sample_rows: int = 1500, sample_length: int = 30000) -> DataFrame:
    """(id, body, outside) for every page of ``df``: the lines of the main body joined by LF, and the numbers
    (from 0) of the non-blank lines outside it, line 0, the browser title, being neither.

    The weights come from ``sample_rows`` pages, chosen by a hash of the text, without those over ``sample_length`` characters; every page is scored as a whole. A page without any line above zero has an empty body; null and empty
    pages have an empty body and nothing outside. Repeated rows give equal results, an empty table an empty
    result; other columns of ``df`` are dropped.
    """
    pages = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    repeats = repeated_lines(pages)
    sample = hash_sample(pages, F.col("text"), sample_rows).filter(F.length("text") <= sample_length).select("text")
    model = train([r["text"] for r in sample.collect()], repeats)

    @F.arrow_udf("struct<body:string,outside:array<int>>")
    def look(column: pa.Array) -> pa.Array:
        out = []
        for page in column.to_pylist():
            lines = (page or "").split("\n")
            inside = set(main_lines(page, model)) if page else set()
            out.append({
                "body": "\n".join(lines[k].strip("\r") for k in sorted(inside)),
                "outside": [k for k in range(1, len(lines)) if k not in inside and lines[k].strip()],
            })
        return pa.array(out, type=pa.struct([("body", pa.string()), ("outside", pa.list_(pa.int32()))]))

    look = look.asNondeterministic()  # else the optimizer runs it once more to filter empty results
    return pages.withColumn("seen", look("text")).select("id", "seen.body", "seen.outside")
