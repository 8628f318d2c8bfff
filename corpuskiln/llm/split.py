"""Splitting oversized texts at natural boundaries by packing a structure tree.

Headings, blank lines, list items, lines and sentence ends give every possible cut a depth, which spans a
tree over the text: a node is cut at the shallowest depth inside it. Sibling subtrees are merged in order
while they fit; only a node over the limit is descended into, in the end to single words and stretches of
eight characters. Each piece but the first begins with the overlap, the end of the piece before it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE_PATTERN = r"[ \t\r\n]*[^ \t\r\n]{1,8}"
#: like SIZE_PATTERN, and ends after a full stop that no space follows in its script
_ATOM = re.compile(r"[ \t\r\n]*(?:[^ \t\r\n。！？]{0,7}[。！？]|[^ \t\r\n。！？]{1,8})")
_HASHES, _NUMBERED = re.compile(r"(#{1,6})\s+\S"), re.compile(r"(\d+(?:\.\d+)*)\.?\s+\S")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•–]|\d{1,3}[.)])\s+\S")
_TAG = re.compile(r"<(?:(h[1-6])|(?:p|div|section|article|table|ul|ol|pre|blockquote)|(li|tr|dt|dd))\b", re.I)
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_CLAUSE = re.compile(r"[,;:—–][\"'”’»)\]]*$")
PLAIN_HEADING, PARAGRAPH, ITEM, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 7, 8, 9, 12, 13, 14, 15, 16

NAMES = {PARAGRAPH: "paragraph", SENTENCE: "sentence", CLAUSE: "clause", WORD: "word", INSIDE: "inside a word"}

PIECES = "array<struct<chunk_index:int,text:string,start:int,end:int,size:int,cut:string>>"


def size_of(text: Column) -> Column:
    """Size of a text in stretches of up to eight characters that are no white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0))


def _line_depths(text: str) -> dict[int, int]:
    """Depth of the cut before each line, by the line's first position."""
    out, lines, at = {}, text.split("\n"), 0
    blank = True
    for k, line in enumerate(lines):
        bare = line.strip(" \t\r")
        if bare:
            after = next((x.strip(" \t\r") for x in lines[k + 1 : k + 3] if x.strip(" \t\r")), "")
            depth = PARAGRAPH if blank else LINE
            if m := _HASHES.match(bare):
                depth = len(m[1])
            elif m := _TAG.match(bare):
                depth = int(m[1][1]) if m[1] else ITEM if m[2] else PARAGRAPH
            elif after and len(set(after)) == 1 and after[0] in "=-" and len(after) >= 3:
                depth = 1 if after[0] == "=" else 2
            elif m := _ITEM.match(line):
                depth = min(ITEM + len(m[1].expandtabs(4)) // 2, LINE - 1)
            elif len(bare) <= 80 and not _ENDS.search(bare) and not _CLAUSE.search(bare) and len(after) > len(bare) and _ENDS.search(after):
                depth = min(2 + m[1].count("."), PLAIN_HEADING) if (m := _NUMBERED.match(bare)) else PLAIN_HEADING
            out[at + len(line) - len(line.lstrip(" \t\r"))] = depth
        blank = not bare
        at += len(line) + 1
    return out


class Cuts:
    """The possible cuts of a text: n + 1 positions, their depths, and the size between any two of them."""

    def __init__(self, text: str):
        found = [m.span() for m in _ATOM.finditer(text)]
        n = len(found)
        self.n, self.at = n, [a for a, _ in found] + [len(text)]
        self.depth = np.full(n + 1, INSIDE, dtype=np.int8)
        run, offset, full, length = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64), [0], []
        lines = _line_depths(text)
        r = -1
        for i, (a, b) in enumerate(found):
            solid = a
            while text[solid] in " \t\r\n":
                solid += 1
            if solid > a or i == 0:
                if r >= 0:
                    full.append(full[-1] + -(-length[r] // 8))
                r += 1
                length.append(0)
                before = text[max(0, a - 4) : a]
                self.depth[i] = lines.get(solid, LINE) if "\n" in text[a:solid] or i == 0 else SENTENCE if _ENDS.search(before) else CLAUSE if _CLAUSE.search(before) else WORD
            elif text[a - 1] in "。！？":
                self.depth[i] = SENTENCE
            run[i], offset[i] = r, length[r]
            length[r] += b - solid
        run[n], offset[n] = r, length[r] if n else 0
        self.run, self.offset, self.length, self.full = run.tolist(), offset.tolist(), length, full

    def size(self, i: int, j: int) -> int:
        a, b = self.run[i], self.run[j]
        if a == b:
            return -(-(self.offset[j] - self.offset[i]) // 8)
        return -(-(self.length[a] - self.offset[i]) // 8) + self.full[b] - self.full[a + 1] + -(-self.offset[j] // 8)

    def back(self, i: int, overlap: int, limit: int) -> int:
        """The last start of a word from which the text up to cut ``i`` has at least size ``overlap``; inside a word only
        if that start is over twice as far, or leaves no room within the limit."""
        s = max(0, i - overlap)
        while s and self.size(s, i) < overlap:
            s -= 1
        word = s
        while word and self.depth[word] == INSIDE and self.size(word, i) <= 2 * overlap:
            word -= 1
        far = self.depth[word] == INSIDE or self.size(word, i) > 2 * overlap or self.size(word, min(i + 1, self.n)) > limit
        return s if far else word


def cut_name(depth: int) -> str:
    """What a cut of this depth stands before."""
    return NAMES.get(depth) or ("heading" if depth <= PLAIN_HEADING else "item" if depth < LINE else "line")


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first position with overlap, first position, end) of each piece; see ``split_cuts``."""
    return [piece[:3] for piece in split_cuts(text, limit, overlap)]


def split_cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(first position with overlap, first position, end, kind of the cut before) of each piece, in order; the stretches
    from the second to the third tile the text."""
    cuts = Cuts(text)
    starts = {0: 0}

    def fits(i: int, j: int) -> bool:
        if i not in starts:
            starts[i] = cuts.back(i, overlap, limit)
        return cuts.size(starts[i], j) <= limit

    pieces: list[tuple[int, int]] = []

    def pack(a: int, i: int, j: int) -> int:
        """Packs the oversized node from ``i`` to ``j`` after an open piece from ``a``; where the piece open then begins."""
        inner = cuts.depth[i + 1 : j]
        b = i
        for end in [*(np.flatnonzero(inner == inner.min()) + i + 1).tolist(), j]:
            if not fits(a, end) and b > a and (fits(b, end) or cuts.size(a, b) * 4 >= limit):
                pieces.append((a, b))
                a = b
            if not fits(a, end):  # the subtree is oversized: descend; a small open piece goes along
                a = pack(a, b, end) if end - b > 1 else cut(a, b)
            b = end
        if cuts.size(a, j) * 4 >= limit:
            pieces.append((a, j))
            a = j
        return a

    def cut(a: int, b: int) -> int:
        pieces.append((a, b))
        return b

    if not cuts.n:
        return [(0, 0, len(text), "start")]
    if fits(0, cuts.n):
        pieces.append((0, cuts.n))
    else:
        rest = pack(0, 0, cuts.n)
        if rest < cuts.n:
            pieces.append((rest, cuts.n))
    return [(cuts.at[starts.get(i, 0)], cuts.at[i], cuts.at[j], cut_name(int(cuts.depth[i]))) if i else (0, 0, cuts.at[j], "start") for i, j in pieces]


def _splitter(limit: int, overlap: int):
    size = re.compile(SIZE_PATTERN)

    @F.arrow_udf(PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            if text is None:
                out.append(None)
                continue
            rows = []
            for k, (s, i, j, cut) in enumerate(split_cuts(text, limit, overlap)):
                piece = text[s:j].strip(" \t\r\n")
                rows.append({"chunk_index": k, "text": piece, "start": i, "end": j, "size": sum(1 for _ in size.finditer(piece)), "cut": cut})
            out.append(rows)
        return pa.array(out, type=pa.list_(pa.struct([("chunk_index", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("cut", pa.string())])))

    return pieces


def split_oversized(df: DataFrame, text_col: str, limit: int, overlap: int = 0, into: str = "piece") -> DataFrame:
    """One row per piece: the columns of ``df`` and a struct ``into`` of chunk_index (from 0, without gaps), text,
    start and end (code points; the stretches tile the text, without the overlap), size (with it) and cut, what the
    piece begins at: start, heading, paragraph, item, line, sentence, clause, word, or inside a word.

    A text of at most ``limit`` is its own single piece, unchanged; null and empty texts likewise (size 0). Pieces
    have at most size ``limit`` and lose white space at their ends; each but the first repeats the last ``overlap``
    of the one before, from the start of a word. Repeated rows are split alike. A column named like ``into`` is replaced. An empty table
    gives an empty result. Only texts over the limit reach Python, one at a time.
    """
    if limit <= 0 or overlap < 0 or overlap >= limit:
        raise ValueError("limit must be positive and overlap from 0 to less than the limit")
    text = F.col(text_col)
    size = size_of(text)
    whole = F.array(F.struct(F.lit(0).alias("chunk_index"), text.alias("text"), F.lit(0).alias("start"), F.coalesce(F.length(text), F.lit(0)).alias("end"), size.alias("size"), F.lit("start").alias("cut")))
    pieces = _splitter(limit, overlap)(F.when(size > limit, text))
    # generated before the other columns are read back, so that unused ones are pruned from the scan
    return df.withColumn(into, F.explode(F.coalesce(pieces, whole)))
