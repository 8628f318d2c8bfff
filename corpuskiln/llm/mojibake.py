"""Finding and restoring text that was decoded with the wrong character encoding.

A hidden Markov model labels the characters of a text: one clean state, one state per pair of encodings
(the true one, and the one it was read in). A state emits each non-ASCII character given the one before it;
these probabilities are counted in all clean texts of the collection, and in the same texts read wrongly on
purpose. ASCII characters look alike in all states and are skipped. Every span labelled with a pair is
encoded and decoded back; a span counts only if that gives proper text.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs of encodings (true, read as); "twice" stands for the same mistake made twice.
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"),
    ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "iso8859-2"),
    ("utf-8 twice", "cp1252"), ("utf-8 twice", "latin-1"),
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1251", "mac_cyrillic"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp1252", "mac_roman"), ("cp1252", "latin-1"), ("cp850", "latin-1"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"),
    ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("shift_jis", "cp1252"), ("euc_jp", "cp1252"),
]
#: pairs whose way back checks itself: text in UTF-8
WIDE_PAIRS = [p for p in PAIRS if p[0].startswith("utf-8")]
# Words near a garbled sequence that is shown as an example.
QUOTING = re.compile(
    r"mojibake|latin-1|utf-8|u\+fffd|cp125|iso-8859|encoding|sequence|symptom|test page|the string|turns? into|was meant|bad byte|cyrillic|garbled|charset|character set|decoder emits",
    re.I,
)
LOST = "�"
_RUN = re.compile(r"[^\x00-\x7f]+")
_CONTROL = re.compile("[\x80-\x9f]")
_ENTITY = re.compile(r"&[A-Za-z]{2,8};")
_GARBLED_ENTITY = re.compile(r"&(?:Atilde|Acirc|acirc|ETH|Ntilde|Auml|Aring|radic);")
LEAVE, LEAST, MARGIN = 3.0, 4, 8.0
#: characters of the texts that are looked through together, and runs remembered; neither changes a result
GROUP, REMEMBERED = 1 << 18, 100_000
#: characters that a pair changes for it to be looked at beside others, pairs for arrays to be faster than numbers; nor do these
MANY, WIDE_PATH = 90, 12
#: cost of entering a pair's state: less where the way back checks itself
ENTER = np.array([5.0 if p[0].startswith("utf-8") else 9.0 for p in PAIRS], dtype=np.float32)


def _read_byte(b: int, wrong: str) -> str:
    try:
        return bytes([b]).decode(wrong)
    except UnicodeDecodeError:
        return chr(b)  # as most programs do


@functools.cache
def _maps(wrong: str):
    """Byte to character, and back, of the encoding that a text was read in."""
    forth = [_read_byte(b, wrong) for b in range(256)]
    return forth, {c: b for b, c in reversed(list(enumerate(forth)))}


def garble(text: str, pair: tuple[str, str]) -> str:
    forth, _ = _maps(pair[1])
    true, _, twice = pair[0].partition(" ")
    codes = np.array([ord(c) for c in forth], dtype="<u4")
    for _ in range(2 if twice else 1):
        text = codes[np.frombuffer(text.encode(true, "ignore"), dtype=np.uint8)].tobytes().decode("utf-32-le")
    return text


@functools.cache
def _changing() -> np.ndarray:
    """Characters (the last stands for all above) by pairs: whether a run needs such a character for ``_restored`` to give anything by the pair."""
    own = np.zeros((0x10000, len(PAIRS)), dtype=bool)
    for k, (true, wrong) in enumerate(PAIRS):
        for b, c in enumerate(_maps(wrong)[0]):
            if true.startswith("utf-8"):
                own[ord(c), k] |= 0xC2 <= b <= 0xF4
            elif true in ("shift_jis", "euc_jp"):
                own[ord(c), k] |= b > 127
            else:
                own[ord(c), k] |= bytes([b]).decode(true, "replace") not in (c, LOST)
    out = own.copy()
    for k, pair in enumerate(PAIRS):
        out[:, k] = own[:, [PAIRS.index(p) for p in _alike(pair)]].any(axis=1)
    return out


@functools.cache
def _kinds() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pairs that are looked at together: of the same cost of entering, those that change few characters apart from others. Their
    numbers, the costs, and ``_changing`` for any of them."""
    few = _changing().sum(axis=0)
    of = list(zip(ENTER.tolist(), np.where(few < MANY, few, 0).tolist()))
    kinds = sorted(set(of))
    pairs = [np.flatnonzero([k == kind for k in of]) for kind in kinds]
    return pairs, np.array([cost for cost, _ in kinds]), np.stack([_changing()[:, p].any(axis=1) for p in pairs], axis=1)


def _alike(pair: tuple[str, str]) -> list[tuple[str, str]]:
    """The pair, then those by which its runs are put right too."""
    wide = pair[0].startswith("utf-8")
    return [pair, *(q for q in PAIRS if wide and q != pair and (q[0] == pair[0] or q[0] == "utf-8" and q[1] == pair[1]))]


@functools.lru_cache(100_000)
def restore(run: str, pair: tuple[str, str]) -> str | None:
    """The original of a run of garbled characters, None if it can't be."""
    _, back = _maps(pair[1])
    true, _, twice = pair[0].partition(" ")
    for _ in range(2 if twice else 1):
        try:
            run = bytes(back[c] for c in run).decode(true)
        except (KeyError, UnicodeDecodeError):
            return None
    return run


def _observations(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the non-ASCII characters, and each with the class of the one before: its key."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero(c > 127)
    prev = np.where(at > 0, c[at - 1], 32).astype(np.int64)
    letter = ((prev | 32) >= 97) & ((prev | 32) <= 122)
    prev = np.where(prev > 127, prev, np.where(letter, 1, np.where((prev >= 48) & (prev <= 57), 2, 0)))
    return at, (prev << 21) | c[at]


def _log_probabilities(keys: np.ndarray, counts: np.ndarray, all_keys: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each known bigram given its first character, and of each known character alone."""
    single = np.zeros(len(chars))
    np.add.at(single, np.searchsorted(chars, keys & 0x1FFFFF), counts)
    alone = 0.999 * single / max(1.0, single.sum()) + 0.001 / 20000
    firsts, inverse = np.unique(all_keys >> 21, return_inverse=True)
    n = np.zeros(len(all_keys))
    n[np.searchsorted(all_keys, keys)] = counts
    total = np.zeros(len(firsts))
    np.add.at(total, inverse, n)
    both = (n + 2 * alone[np.searchsorted(chars, all_keys & 0x1FFFFF)]) / (total[inverse] + 2)
    return np.log(both), np.log(alone)


def _counted(text: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the observations in weighted runs, one a line, each led by the character before it, and their counts."""
    at, keys = _observations(text)
    lines = np.cumsum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 10)
    known, inverse = np.unique(keys, return_inverse=True)
    counts = np.zeros(len(known), dtype=np.int64)
    np.add.at(counts, inverse, weights[lines[at]])
    return known, counts


def _count_states(runs: Counter) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of runs as they are, then of each pair's: the runs read wrongly."""
    text, weights = "\n".join(runs), np.array([*runs.values(), 0], dtype=np.int64)
    return [_counted(text, weights), *(_counted(garble(text, p), weights) for p in PAIRS)]


class Model:
    """Log-likelihood ratios of the pairs' states against the clean one, by key and by character."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]]):
        """From keys and counts of each state, the clean one first."""
        self.keys = np.unique(np.concatenate([k for k, _ in counted]))
        self.chars = np.unique(self.keys & 0x1FFFFF)
        logs = [_log_probabilities(k, n, self.keys, self.chars) for k, n in counted]
        self.clean, self.clean_alone = logs[0]
        self.both = np.stack([b - logs[0][0] for b, _ in logs[1:]], axis=1).astype(np.float32)
        self.alone = np.stack([a - logs[0][1] for _, a in logs[1:]], axis=1).astype(np.float32)
        self.proper = {chr(c) for c in np.unique(counted[0][0] & 0x1FFFFF).tolist()}
        self.most, self.most_alone = (np.stack([r[:, p].max(axis=1) for p in _kinds()[0]], axis=1) for r in (self.both, self.alone))
        self.tried: dict[tuple[str, tuple[str, str]], str | None] = {}  # what ``_restored`` gave

    def likelihood(self, text: str) -> float:
        """Log-likelihood of the non-ASCII characters of a text in the clean state."""
        _, keys = _observations(text)
        out = np.full(len(keys), np.log(1e-8))
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            c = keys & 0x1FFFFF
            j = np.minimum(np.searchsorted(self.chars, c), len(self.chars) - 1)
            single, known = self.chars[j] == c, self.keys[i] == keys
            out[single] = self.clean_alone[j[single]]
            out[known] = self.clean[i[known]]
        return float(out.sum())

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """Of every pair, for each key."""
        return self._looked_up(keys, self.both, self.alone)

    def highest(self, keys: np.ndarray) -> np.ndarray:
        """The highest ratio among the pairs of each of ``_kinds``."""
        return self._looked_up(keys, self.most, self.most_alone)

    def _looked_up(self, keys: np.ndarray, both: np.ndarray, alone: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), both.shape[1]), dtype=np.float32)
        if not len(self.keys):
            return out
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[i] == keys
        out[known] = both[i[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            c = keys[new] & 0x1FFFFF
            j = np.minimum(np.searchsorted(self.chars, c), len(self.chars) - 1)
            single = self.chars[j] == c
            out[new[single]] = alone[j[single]]
        return out


def _gains(r: np.ndarray) -> np.ndarray:
    """The best sum of each column over the stretches that end at each row."""
    c = np.cumsum(r, axis=0, dtype=np.float64)
    before = np.zeros_like(c)
    np.minimum.accumulate(c[:-1], axis=0, out=before[1:])
    np.minimum(before, 0, out=before)
    return np.subtract(c, before, out=c)


def _stretches(flags: np.ndarray) -> np.ndarray:
    """(begin, end) of the stretches of true flags."""
    framed = np.zeros(len(flags) + 2, dtype=bool)
    framed[1:-1] = flags
    return np.flatnonzero(framed[1:] != framed[:-1]).reshape(-1, 2)


def _labels(r: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Most likely states: -1 clean, else the pair's number. A stretch in a pair's state neither begins nor ends with a part that sums up
    to less than 0, and pays for entering and leaving; the path is sought among the pairs and places where there can be such, and is clean
    elsewhere. It is not sought where none of these pairs is ``usable``."""
    out = np.full(len(r), -1)
    gains = _gains(r)
    some = np.flatnonzero(gains.max(axis=0) - ENTER >= LEAVE - 0.01)
    if not usable[some].any():
        return out
    rows = np.full((len(some), len(r) + 1), -np.inf)  # of the pairs, each ended by a place that none can be in
    rows[:, :-1] = gains[:, some].T
    del gains  # a long text makes all these large
    may = rows > -1e-6
    may[:, :-1] &= _gains(r[::-1, some])[::-1].T > -1e-6
    at = _stretches(may.ravel())
    at = at[np.maximum.reduceat(rows.ravel(), at[:, 0]) - ENTER[some[at[:, 0] // rows.shape[1]]] >= LEAVE - 0.01]
    del rows
    can = np.zeros(may.size, dtype=np.int8)
    can[at[:, 0]], can[at[:, 1]] = 1, -1
    can = np.cumsum(can, dtype=np.int8).reshape(may.shape) > 0
    for x, y in _stretches(can[:, :-1].any(axis=0)):
        own = some[can[:, x:y].any(axis=1)]
        if usable[own].any():
            path = _path(r[x:y, own], ENTER[own])
            out[x:y] = np.where(path < 0, -1, own[path])
    return out


def _path(r: np.ndarray, enter_cost: np.ndarray) -> np.ndarray:
    """Most likely states: -1 clean, else the pair's number."""
    came, left, state = (_forward_few if r.shape[1] <= WIDE_PATH else _forward)(r, enter_cost)
    out = np.empty(len(r), dtype=np.int64)
    for t in range(len(r) - 1, -1, -1):
        out[t] = state
        if state < 0:
            state = left[t]
        elif not came[t][state]:
            state = -1
    return out


def _forward(r: np.ndarray, enter_cost: np.ndarray) -> tuple[Sequence[Sequence[bool]], list[int], int]:
    """The pairs whose state was stayed in and where clean came from, by place, and the last state."""
    came, left = np.empty(r.shape, dtype=bool), []
    clean, pair, enter = 0.0, np.full(r.shape[1], -np.inf), np.empty(r.shape[1])
    enter_cost = enter_cost.astype(np.float64)
    for t, row in enumerate(r.astype(np.float64)):
        best = int(pair.argmax())
        top = float(pair[best])
        np.subtract(clean, enter_cost, out=enter)
        np.greater_equal(pair, enter, out=came[t])
        np.maximum(pair, enter, out=pair)
        pair += row
        if top - LEAVE > clean:
            clean = top - LEAVE
            left.append(best)
        else:
            left.append(-1)
    best = int(pair.argmax())
    return came, left, best if pair[best] - LEAVE > clean else -1


def _forward_few(r: np.ndarray, enter_cost: np.ndarray) -> tuple[Sequence[Sequence[bool]], list[int], int]:
    """``_forward`` by numbers, faster for few pairs."""
    costs, came, left = enter_cost.tolist(), [], []
    clean, pair = 0.0, [-np.inf] * len(costs)
    for row in r.tolist():
        top = max(pair)
        enter = [clean - cost for cost in costs]
        came.append([p >= e for p, e in zip(pair, enter)])
        new = [(p if p >= e else e) + x for p, e, x in zip(pair, enter, row)]
        if top - LEAVE > clean:
            clean = top - LEAVE
            left.append(pair.index(top))
        else:
            left.append(-1)
        pair = new
    top = max(pair)
    return came, left, pair.index(top) if top - LEAVE > clean else -1


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in their order, as many together as have ``GROUP`` characters, or one."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _suspects(texts: list[str], model: Model) -> np.ndarray:
    """Whether a stretch of a text may pay for entering and leaving the state of a pair that something can be put right by, were every
    character given the best pair of its kind; a text without is clean."""
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    at, keys = _observations("\n".join(texts))  # a line's end is of the same class as no character at all
    out = np.zeros(len(texts), dtype=bool)
    if not len(at):
        return out
    _, costs, changing = _kinds()
    text = np.searchsorted(ends, at, side="right")
    begins = np.diff(text, prepend=-1) > 0
    first = np.flatnonzero(begins)
    place = np.arange(len(at)) + np.cumsum(begins)
    high = np.zeros((len(at) + len(first), len(costs)))
    high[place] = model.highest(keys)
    high[place[first] - 1] = -1e4  # no stretch goes on in the next text; were one to gain more, the text would be looked at in vain
    gains = np.maximum.reduceat(_gains(high), place[first], axis=0)
    usable = np.logical_or.reduceat(changing[np.minimum(keys & 0x1FFFFF, 0xFFFF)], first, axis=0)
    out[text[first]] = (usable & (gains - costs >= LEAVE - 0.02)).any(axis=1)
    return out


def _quoted(text: str, a: int, b: int) -> bool:
    """Whether the run is an example in a text about such runs: no part of a word, with words about them around."""
    if text[a - 1 : a].isascii() and text[a - 1 : a].isalpha() or text[b : b + 1].isascii() and text[b : b + 1].isalpha():
        return False
    return bool(QUOTING.search(text[max(0, a - 90) : b + 60]))


def _restored(run: str, pair: tuple[str, str], model: Model) -> str | None:
    """The run put right, by its own pair or one alike; None if no way back gives proper characters."""
    if (run, pair) not in model.tried:
        if len(model.tried) >= REMEMBERED:
            model.tried.clear()
        model.tried[run, pair] = _tried(run, pair, model)
    return model.tried[run, pair]


def _tried(run: str, pair: tuple[str, str], model: Model) -> str | None:
    """What ``_restored`` gives, not looked up."""
    wide = pair[0].startswith("utf-8")
    for p in _alike(pair):
        new = restore(run, p)
        if new is not None and new != run and (not wide or len(new) < len(run)) and 2 * sum(c in model.proper or c.isascii() for c in new) >= len(new):
            return new
    return None


def _untidy(text: str, x: int, y: int, new: str) -> int:
    """Signs inside words and changes of case against the rule, with ``new`` in the place of a run."""
    t = text[max(0, x - 2) : x] + new + text[y : y + 2]
    n = 0
    for k in range(1, len(t)):
        a, b = t[k - 1], t[k]
        n += a.islower() and b.isupper() or k > 1 and t[k - 2].isupper() and a.isupper() and b.islower()
        n += k + 1 < len(t) and a.isalpha() and t[k + 1].isalpha() and not b.isalpha() and not b.isascii() and b not in "’‘·–—"
    return n


def _run_begin(text: str, x: int, least: int) -> int:
    while x > least and text[x - 1] > "\x7f":
        x -= 1
    return x


def _run_end(text: str, y: int) -> int:
    while y < len(text) and text[y] > "\x7f":
        y += 1
    return y


def _once(text: str, model: Model) -> tuple[int, str]:
    """Spans found garbled and the text with them put right."""
    at, keys = _observations(text)
    if not len(at):
        return 0, text
    labels = _labels(model.ratios(keys), _changing()[np.minimum(keys & 0x1FFFFF, 0xFFFF)].any(axis=0))
    if (labels < 0).all():
        return 0, text
    found, out, done = 0, [], 0
    edges = np.flatnonzero(np.diff(labels)) + 1
    for first, last in zip(np.r_[0, edges], np.r_[edges, len(labels)]):
        if labels[first] < 0:
            continue
        pair = PAIRS[labels[first]]
        begin, end = int(at[first]), int(at[last - 1]) + 1
        good = []
        for m in _RUN.finditer(text[begin:end]):
            x, y = m.start() + begin, m.end() + begin
            a, b = (_run_begin(text, x, done) if x == begin else x), (_run_end(text, y) if y == end else y)
            for a, b in dict.fromkeys([(a, b), (a, y), (x, b), (x, y)]):  # a label may stop inside a run
                if (new := _restored(text[a:b], pair, model)) is not None:
                    good.append((a, b, new))
                    break
        if not good or "twice" not in pair[0] and all(_quoted(text, x, y) for x, y, _ in good):
            continue
        if not pair[0].startswith("utf-8"):
            old, new = (model.likelihood("".join(text[max(0, x - 1) : x] + t for x, t in ts)) for ts in ([(x, text[x:y]) for x, y, _ in good], [(x, n) for x, _, n in good]))
            control = any("\x80" <= c <= "\x9f" for x, y, _ in good for c in text[x:y])
            tidier = sum(_untidy(text, x, y, text[x:y]) - _untidy(text, x, y, n) for x, y, n in good)
            if new - old < MARGIN or tidier < 0 or last - first < LEAST and not control and not tidier:
                continue
        found += 1
        for x, y, new in good:
            out += [text[done:x], new]
            done = y
    return found, "".join(out) + text[done:]


def _unescaped(text: str) -> str:
    return html.unescape(text) if _ENTITY.search(text) and _GARBLED_ENTITY.search(text) else text


def examine(text: str, model: Model) -> tuple[int, int, str]:
    """(stretches found garbled, characters lost for good, text restored)."""
    return next(examine_all([text], model))


def examine_all(texts: Iterable[str], model: Model) -> Iterator[tuple[int, int, str]]:
    """What ``examine`` gives for each text."""
    for group in _groups(texts):
        new = [_unescaped(t) for t in group]
        for t, n, suspect in zip(group, new, _suspects(new, model).tolist()):
            yield _examined(t, n, suspect, model)


def _examined(text: str, new: str, suspect: bool, model: Model) -> tuple[int, int, str]:
    lost = sum(1 for m in re.finditer(LOST, new) if not _quoted(new, m.start(), m.end())) if LOST in new else 0
    found, new = _once(new, model) if suspect else (0, new)
    again, before = found, {text}
    while again and new not in before:  # a mistake made more than once
        before.add(new)
        again, new = _once(new, model)
    return found + (lost > 0), lost, new if found else text


def _runs(text: str) -> list[str]:
    """Runs of non-ASCII characters, each with the character before it."""
    return [text[max(0, m.start() - 1) : m.end()] for m in _RUN.finditer(text)]


def _readable(run: str, common: set[str]) -> bool:
    """Whether a run can be read back into common characters."""
    run = run.lstrip("".join(map(chr, range(128))))
    if len(run) > 1:
        for p in [q for q in WIDE_PAIRS if "twice" not in q[0]]:
            new = restore(run, p)
            if new is not None and len(new) < len(run) and all(c in common for c in new):
                return True
    return False


def _garbled_run(run: str, common: set[str]) -> bool:
    return LOST in run or _CONTROL.search(run) is not None or _readable(run, common)


def _plain_runs(text: str, common: set[str], known: dict[str, str]) -> list[str] | None:
    """The runs of a text, led by a sign of the kind of the character before; None for texts that look garbled. ``known``
    keeps what came of runs, nothing of garbled ones."""
    if _ENTITY.search(text):
        return None
    out = []
    for run in _runs(text):
        plain = known.get(run)
        if plain is None:
            plain = known[run] = "" if _garbled_run(run, common) else _led(run)
        if not plain:
            return None
        out.append(plain)
    return out


def _led(run: str) -> str:
    lead = run[0]
    kind = "" if not lead.isascii() else "a" if lead.isalpha() else "0" if lead.isdigit() else " "
    return kind + run[1:] if kind else " " + run


def _common(seen: dict[str, int], texts: int) -> set[str]:
    return {c for c, n in seen.items() if n * 200 >= texts}


def _characters(texts: Iterable[str]) -> Counter:
    """In how many texts each non-ASCII character is; under the empty one, the number of texts."""
    seen = Counter()
    for t in texts:
        seen.update(c for c in set(t) if c > "\x7f")
        seen[""] += 1
    return seen


def _gather(texts: Iterable[str], common: set[str], first: Model | None) -> Iterator[Counter]:
    """Runs of the texts that do not look garbled, in parts; with a first model, only of those that it finds all the same."""
    known, runs = {}, Counter()
    for group in _groups(texts):
        for t in group if first is None else itertools.compress(group, _suspects(group, first)):
            own = _plain_runs(t, common, known)
            if own and (first is None or _once(t, first)[0]):
                runs.update(own)
            if max(len(runs), len(known)) > 200_000:
                yield runs
                known, runs = {}, Counter()
    yield runs


def _summed(parts: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts by state of (state, keys, counts), without keys whose counts come to 0."""
    by = [([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]) for _ in range(len(PAIRS) + 1)]
    for state, keys, counts in parts:
        by[state][0].append(keys)
        by[state][1].append(counts)
    out = []
    for keys, counts in by:
        known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(known), dtype=np.int64)
        np.add.at(total, inverse, np.concatenate(counts))
        out.append((known[total != 0], total[total != 0]))
    return out


def _parts(runs: Counter, sign: int = 1) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(k, keys, sign * counts) for k, (keys, counts) in enumerate(_count_states(runs))]


def train(texts: list[str]) -> Model:
    """From texts that are mostly clean: those that look garbled, then those the first model finds, are left out."""
    seen = _characters(texts)
    common = _common(seen, seen.pop("", 0))
    all_ = [p for runs in _gather(texts, common, None) for p in _parts(runs)]
    found = [p for runs in _gather(texts, common, Model(_summed(all_))) for p in _parts(runs, -1)]
    return Model(_summed(all_ + found))


def train_on(texts: DataFrame) -> Model:
    """The model that ``train`` makes of all of ``texts`` (text): each task counts characters, then pairs of characters by state, in
    its own; the counts, as many as there are different ones, are summed up and collected."""

    def count(batches):
        seen = _characters(t for batch in batches for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["sign", "n"])

    seen = {r["sign"]: r["n"] for r in texts.mapInArrow(count, "sign string, n bigint").groupBy("sign").agg(F.sum("n").alias("n")).collect()}
    common = _common(seen, seen.pop("", 0))

    def states(first: Model | None, sign: int):
        def run(batches):
            for runs in _gather((t for batch in batches for t in batch.column("text").to_pylist()), common, first):
                for state, keys, counts in _parts(runs, sign):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), state), pa.int32()), pa.array(keys), pa.array(counts)], names=["state", "key", "n"])

        got = texts.mapInArrow(run, "state int, key bigint, n bigint").groupBy("state", "key").agg(F.sum("n").alias("n")).toArrow()
        state, keys, counts = (got.column(c).to_numpy() for c in ("state", "key", "n"))
        return [(k, keys[state == k], counts[state == k]) for k in range(len(PAIRS) + 1)]

    all_ = states(None, 1)
    return Model(_summed(all_ + states(Model(_summed(all_)), -1)))


def restore_encoding(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, garbled, lost, restored) for every row of ``df``.

    ``garbled`` counts the stretches read in a wrong encoding (one for all characters replaced by U+FFFD, whose
    number is ``lost``), ``restored`` is the text with them put right as far as possible; a row without any, with a
    null or an empty text has 0 and its text unchanged. Sequences that a text only shows as examples do not count.
    The model is trained on all texts with non-ASCII characters or entities, of any length; every text is examined as a whole.
    Repeated rows give equal results; an empty table gives an empty result. Other columns of ``df`` are dropped.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    odd = F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]|&[A-Za-z]+;"), F.lit(False))
    model = train_on(texts.filter(odd).select("text"))

    @F.arrow_udf("struct<garbled:int,lost:int,restored:string>")
    def look(column: pa.Array) -> pa.Array:
        found = examine_all((t for t in column.to_pylist() if t is not None), model)
        rows = [next(found) if ok else (0, 0, None) for ok in column.is_valid().to_pylist()]
        return pa.StructArray.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] if r[0] else None for r in rows], pa.string()),
            ],
            names=["garbled", "lost", "restored"],
        )

    seen = look.asNondeterministic()(F.when(odd, F.col("text")))  # else the optimizer runs it once more to filter
    return (
        texts.withColumn("seen", seen)
        .select("id", "text", F.coalesce("seen.garbled", F.lit(0)).alias("garbled"), F.coalesce("seen.lost", F.lit(0)).alias("lost"), F.coalesce("seen.restored", "text").alias("restored"))
    )
