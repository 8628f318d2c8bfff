"""Template residue, filler and error pages, by aligning records of one template over the whole corpus.

Texts are cut into units (lines, and sentences of lines) and units into tokens. Three things are aligned:

* Slots. A mark (a name in brackets or signs, a gap) is compared with what all other records have between the same
  words, whatever these records are. Where they have words, nothing, or another mark, the place is a slot, and the mark was
  left in it. Where the records differ in their other words but have this very mark, it is the template's own text.
* Pages. Names, numbers and rare words vary between records of a template and are masked, which leaves its
  skeleton. A skeleton found in many texts which mostly consist of nothing but such skeletons is a line of an error page, a notice
  or a stub; whatever text has it is residue.
* Seeds. Phrases and spellings of marks known beforehand count where too few records exist to align them; like marks,
  they are own text where records that differ elsewhere share them.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.tables import written

# Spellings of slots left unfilled, the seeds for marks that no other record can be aligned with.
SLOT = re.compile(
    r"\{\{\{?\s*[#/&>^]?\s*[A-Za-z_][\w.| ]{0,40}\s*\}?\}\}|\$\{[A-Za-z_][\w.]{0,40}\}|[%#]\{[A-Za-z_][\w.]{0,40}\}|%\([A-Za-z_]\w{0,40}\)[sd]|<%[=-]?\s*[\w. ]{1,40}\s*-?%>"
    r"|\{%-?\s*[\w. ]{1,60}\s*-?%\}|\{(?:\d|[a-z_][\w.]{1,40})\}|\b__[A-Z][A-Z_]{2,40}__|\[\[[A-Za-z_ ]{2,40}\]\]|%[A-Z][A-Z_]{2,30}%|\$[A-Z][A-Z_]{2,30}\$|@@\w{2,30}@@"
    r"|\[(?:insert|your|enter|add|put)\b[^\]\n]{0,40}\]|\[[A-Z][A-Z]+(?:[ _][A-Z]+)*\]|\[(?:first name|last name|name|company|product|price|date|city|title|url|author|version|topic|count|body|summary|site name|user name|order id|item label|page heading|address|email|phone)\]"
    r"|<(?:insert|your|enter)\b[^>\n]{0,40}>|<[A-Z][A-Z]+(?:[ _.][A-Z]+)*>|\bTKTK\b|«[A-Z][A-Z_]{2,30}»|&lt;[A-Za-z][A-Za-z_. ]{1,30}&gt;|<(?:first_?name|last_?name|name|company|product|price|date|city|url|author|version|topic|count|site_?name|user_?name|order_?id|item_?label|page_?heading)>|\bX{3,}\b|\bxx[x-]*xx\b|_{4,}"
)
# Bare values of programs where a value should be.
VALUE = re.compile(r"\[object Object\]|(?:^|[:=,]\s*)(?:undefined|NaN|null|None|nil|N/A)(?=\s*(?:$|[,;.)]|items?\b|[A-Za-z]*$))|\b(?:undefined|NaN)\b(?=\s*(?:$|[.,;]))|^(?:undefined|null|NaN|None)\b|(?<!or )\bundefined\b(?! (?:until|or|behaviou?r|method|index|variable))|\bNaN\b", re.M)
# Filler and stubs.
FILLER = re.compile(
    r"\b(?:lorem ipsum|dolor sit|amet consectetur)\b|\b(?:goes|go) here\b|^\s*(?:heading|paragraph|caption|title|item|section|subtitle|text|image|column)(?: here| \d+)\.?\s*$|^\W*(?:TODO|TBD|FIXME|TBC|WIP|N/A)\b(?! marks)|\bto be (?:written|added|announced|completed|determined|done)\b"
    r"|\bcoming soon\b|wording to follow|placeholder (?:copy|text)|keep it to two or three lines|add a short (?:description|summary)|write (?:this section|something|your text|here)|sample text|dummy text|your text here|replace this|nothing here yet|left this page empty|under construction|body copy|copy pending|edit this page to|content follows|more soon|details? to follow"
    r"|folgt in kürze|schreiben sie hier|escrib[ae] aquí|escreva aqui|écrivez ici|wpisz tutaj|напишите здесь|ここに(?:本文|テキスト|文章)|inhalt folgt|hier steht|blindtext|platzhalter|bald verfügbar|in bearbeitung|à venir|bientôt|contenu à|texte à|en construction|próximamente|en construcción|texto de (?:ejemplo|relleno)|em breve|em construção|texto de exemplo|wkrótce|w budowie|tekst zastępczy|скоро|в разработке|текст-заполнитель|здесь будет|準備中|工事中|近日公開|ダミーテキスト",
    re.I | re.M,
)
# Messages that something failed or cannot be shown.
MESSAGE = re.compile(
    r"\b(?:error|erreur|fehler|erro|błąd|ошибка|エラー|http status|status)\s*[:#–-]?\s*[1-5]\d\d\b|^\W*[45]\d\d\b\s*[-–:|]?\s*(?:\(?\w+|$)(?:\s+\w+){0,3}\W*$|\b[45]\d\d (?:not found|forbidden|gone|bad gateway|gateway timeout|service unavailable|internal server error|unauthorized|too many requests|bad request)\b"
    r"|traceback \(most recent|\bexception\b.*\bat \w+[.(]|\bat [\w.$]+\([\w.]+:\d+\)|fatal error|parse error|stack trace:|segmentation fault|core dumped|uncaught|syntaxerror|typeerror|keyerror|valueerror|nullpointer|warning: (?:database|mysql|pg_|include|undefined|cannot)|database connection failed|error establishing|call to undefined|internal (?:server error|problem)|bad gateway|gateway time-?out|timed out after"
    r"|too many requests|rate limit exceeded|access (?:to this resource is )?denied|access denied|permission to (?:view|access)|not authori[sz]ed|forbidden\W*$|session has (?:expired|timed out)|sign in again|log in to (?:continue|read)|members only|subscribers only|verify (?:that )?you are (?:human|not)|checking your browser|captcha|unusual traffic"
    r"|page (?:you (?:are looking for|requested|want)|not found|does not exist|(?:has |was )?(?:been )?(?:moved|removed|deleted))|can(?:'|’)?t find that page|could(?: not|n't|n’t) (?:be found|complete your|load|find)|might have (?:expired|moved|been)|no longer (?:exists|available)|no results found|service (?:is )?(?:temporarily )?unavailable|down for maintenance|under maintenance|be back soon|try again (?:in|later)|something went wrong|an? (?:unexpected |internal )?error (?:has )?occurred|redirecting you to|domain (?:is parked|has expired|is for sale)|at your registrar|click here if nothing happens|content is not available|not available in your (?:country|region)|whoops|oops|we(?:'|’)re sorry"
    r"|seite nicht gefunden|nicht (?:mehr )?gefunden\W*$|existiert nicht|nicht (?:mehr )?verfügbar\W*$|zugriff verweigert|interner serverfehler|serverfehler|wartungsarbeiten|wird gewartet|versuchen sie es später|ein fehler ist aufgetreten|sitzung (?:ist )?abgelaufen"
    r"|page introuvable|introuvable|n[’']existe plus|indisponible\W*$|momentanément indisponible|accès (?:refusé|interdit)|erreur interne|réessayez plus tard|une erreur (?:est survenue|s[’']est produite)|session a expiré|désolés?\b"
    r"|página no encontrada|no encontrad[ao]|ya no existe|no está disponible|acceso denegado|error interno|inténtelo (?:de nuevo )?más tarde|ha ocurrido un error|sesión ha (?:caducado|expirado)|lo sentimos"
    r"|página não encontrada|não (?:foi )?encontrad[ao]|não existe mais|acesso negado|indisponível|erro interno|tente novamente|ocorreu um erro|desculpe"
    r"|nie znaleziono|nie istnieje|odmowa dostępu|brak dostępu|niedostępn[aey]\W*$|tymczasowo niedostępn|wewnętrzny błąd|spróbuj ponownie|wystąpił błąd|przepraszamy"
    r"|страница не найдена|не найден[ао]?\b|не существует|доступ запрещ|недоступ(?:ен|на|но)\b|внутренняя ошибка|попробуйте позже|произошла ошибка|извините|технические работы"
    r"|見つかりません|存在しません|アクセスが?拒否|利用できません|内部エラー|サーバーエラー|しばらくして|エラーが発生|メンテナンス|申し訳",
    re.I | re.M,
)
# Notices that scripts are needed.
SCRIPTS = re.compile(
    r"\b(?:enable|allow|activate|turn on|switch on|permit)\b[^.\n]{0,20}\b(?:javascript|scripts?|scripting)\b|\bjavascript\b[^.\n]{0,30}\b(?:is |to be |must be )?(?:blocked|disabled|deactivated|off|turned off|switched off|required|needed|inactive|enabled|allowed)\b|requires? (?:javascript|scripts)|(?:without|needs) (?:javascript|scripts|scripting) (?:enabled|allowed|on|turned on)|works best with (?:scripting|javascript|scripts)|scripting is (?:off|disabled|deactivated|blocked|turned off|not)|browser (?:is not supported|has (?:them|scripts|javascript))"
    r"|(?:aktivieren|erlauben|schalten|einschalten)\b[^.\n]{0,30}\b(?:javascript|skripte?)|\b(?:javascript|skripte?)\b[^.\n]{0,30}\b(?:aktivieren|erlauben|benötigt|deaktiviert|gesperrt|einschalten)|benötigt (?:javascript|skripte)|browser hat sie"
    r"|(?:activer|autoriser|activez|autorisez)\b[^.\n]{0,20}\b(?:javascript|scripts)|besoin de (?:javascript|scripts)|scripts? (?:sont )?(?:désactivés|bloqués)"
    r"|(?:activ[ae]|habilit[ae]|permit[ae]|active|ative)\b[^.\n]{0,20}\bjavascript|necesita (?:javascript|scripts)|(?:javascript|scripts)[^.\n]{0,20}(?:bloquead|desactivad|desativad)|precisa de (?:javascript|scripts)"
    r"|(?:włącz|zezwól|aktywuj|odblokuj)\w*[^.\n]{0,20}(?:javascript|skrypt)|wymaga (?:javascript|skrypt)|skrypt\w*[^.\n]{0,20}(?:wyłączon|zablokowan)"
    r"|(?:включите|разрешите|активируйте)[^.\n]{0,20}(?:javascript|сценари|скрипт)|нужн[аоы]?[^.\n]{0,12}(?:javascript|сценарии|скрипты)|(?:сценарии|скрипты)[^.\n]{0,20}(?:отключ|выключ|заблок)"
    r"|(?:javascript|スクリプト)[をがは][^。\n]{0,20}(?:有効|許可|必要|無効|オン)",
    re.I,
)
# The first words of filler Latin; its other words are learned beside them.
LATIN = {"lorem", "ipsum", "dolor", "elit", "amet", "consectetur"}

KINDS = (("filler", FILLER), ("value", VALUE), ("scripts", SCRIPTS), ("message", MESSAGE))
# letters that match others without case but are not lower-cased to them
_RARE = re.compile(r"[ſıİ\u1c80-\u1c88]")


def alternatives(pattern: str) -> list[str]:
    """The parts between the outermost bars of a pattern."""
    out, depth, inside, start, k = [], 0, False, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            k += pattern[k + 1] == "^"
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*out, pattern[start:]]


def _needed(tree) -> frozenset[str] | None:
    """Lower-case strings one of which is in every match of a parsed pattern; None if there are no such."""
    found, run = [], ""
    for op, av in [*tree, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(av).lower()
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if run:
            found.append(frozenset({run}))
            run = ""
        part = None
        if name == "SUBPATTERN":
            part = _needed(av[-1])
        elif name == "BRANCH":
            each = [_needed(x) for x in av[1]]
            part = None if None in each else frozenset().union(*each)
        elif name.endswith("_REPEAT") and av[0] > 0:
            part = _needed(av[2])
        if part:
            found.append(part)
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


@functools.lru_cache(maxsize=1)
def phrases() -> list[tuple[str, re.Pattern, frozenset[str] | None]]:
    """(kind, pattern, strings one of which is in every match) of every alternative of the patterns of all kinds."""
    out = []
    for kind, pattern in KINDS:
        for part in alternatives(pattern.pattern):
            out.append((kind, re.compile(part, pattern.flags), _needed(_parser.parse(part, pattern.flags))))
    return out


@functools.lru_cache(maxsize=1)
def _finder():
    """Finds in a lower-case unit which phrases can occur, by their numbers; and those that always can."""
    import ahocorasick

    found: dict[str, set[int]] = {}
    for n, (_, _, needed) in enumerate(phrases()):
        for w in needed or ():
            found.setdefault(w, set()).add(n)
    finder = ahocorasick.Automaton()
    for w, numbers in found.items():
        finder.add_word(w, tuple(numbers))
    finder.make_automaton()
    return finder, frozenset(n for n, (_, _, needed) in enumerate(phrases()) if not needed)


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"“«¿¡(\[]?[^\W\d_a-z])|(?<=[。！？])")
_NAME = r"[^\W\d_][\w.-]*(?:[ |]{1,3}[\w.-]+){0,4}"
#: a mark by its shape alone: a name in brackets or between signs, a joined name, a row of crosses or lines, a gap before a comma or full stop
_MARK = (
    r"(?:[$#%@]?\{{1,3}[%#/&>^=-]?|\[{1,2}%?|<[%?]?[=-]?|&lt;|%\()\s*" + _NAME + r"\s*[-%?]{0,2}(?:\}{1,3}|\]{1,2}|>|&gt;|\)[sd]?)"
    r"|[$#%@]?\{\d\}|«[A-Z][A-Z_.]+»|(?<![\w*])(?:\*\||[$#%@~^*]{1,2}|__)[^\W\d_][\w.]*?(?:\|\*|[$#%@~^*]{1,2}|__)(?![\w*])"
    r"|\bTKT?K?\b|\b[Xx]{3,}\b|\bxx[x-]*xx\b|_{4,}|\b[^\W\d_]+(?:_[^\W_]+)+\b|(?<=\w) (?=[,.](?:\s|$))"
)
MARK = re.compile(_MARK)
_ODD = re.compile(r"[{<«]|\[(?!\d+\])|[$#%@*~^_](?=[\w{(|$#%@*~^])|&lt;|TK|[Xx]{3}|xx[x-]| [,.](?:\s|$)")
_PLAIN = r"(?<![\w<])/\w[\w./-]*|[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]|_+"
_TOKEN, _TOKEN_PLAIN = re.compile(_MARK + "|" + _PLAIN), re.compile(_PLAIN)
_WORD = re.compile(r"[^\W\d_]+")
_GOLD, _SPLIT, _SPLIT2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HOLE, _SLOT, _EDGE = 1, 2, 3  # hashes of what varies, of a mark, and of the end of a unit


def tokens_of(unit: str) -> list[str]:
    """Words, numbers and signs; a mark is one token."""
    return (_TOKEN if _ODD.search(unit) else _TOKEN_PLAIN).findall(unit)


def units(text: str) -> list[str]:
    return [s for line in text.split("\n") if line.strip() for s in map(str.strip, _SENTENCE.split(line)) if s]


@functools.lru_cache(maxsize=1 << 17)
def _hash(token: str) -> int:
    """Hash of a token without case, of any number alike, of any mark alike."""
    import xxhash

    if token.isdigit():
        token = "0"
    elif len(token) > 1 and not token[0].isalpha() and token[0] != "/" or token == " " or MARK.fullmatch(token):
        return _SLOT
    return xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _SPLIT
    h = (h ^ (h >> np.uint64(27))) * _SPLIT2
    return h ^ (h >> np.uint64(31))


def _chain(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind, dtype=np.uint64)
    for p in parts:
        h = _mix(h * _GOLD + p)
    return h


def _chain_one(kind: int, parts) -> int:
    """``_chain`` of single values."""
    full, h = (1 << 64) - 1, kind
    for p in parts:
        h = (h * 0x9E3779B97F4A7C15 + p) & full
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & full
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & full
        h ^= h >> 31
    return h


def _aligned(mark: str, left: list[int], right: list[int]) -> list[int]:
    """Contexts of a mark to look for in other records, the lowest bit set where one record is not enough: on one side of
    a mark, and around a gap, where only a word counts as something else."""
    keys, wide = _around(left, right)
    if mark.strip():
        return [k & ~1 | (j > 1) for j, (k, w) in enumerate(zip(keys, wide)) if w]
    a, b = [_EDGE, _EDGE, *left], [*right, _EDGE, _EDGE]
    return [_chain_one(5, (a[-2], a[-1], b[0])) | 1, _chain_one(6, (a[-1], b[0], b[1])) | 1]


def _around(left: list[int], right: list[int]) -> tuple[list[int], list[bool]]:
    """The four contexts of a place: two words before and one after, one and two, three before, three after; and
    for each whether it has words enough: not the ends of the unit alone."""
    a, b = [_EDGE] * max(0, 3 - len(left)) + left[-3:], right[:3] + [_EDGE] * max(0, 3 - len(right))
    sides = [(a[1], a[2], b[0]), (a[2], b[0], b[1]), tuple(a), tuple(b)]
    return [_chain_one(k + 1, s) for k, s in enumerate(sides)], [sum(x == _EDGE for x in s) <= (1 if k < 2 else 0) for k, s in enumerate(sides)]


class Vocabulary:
    """Hashes of the words in at least a share of all texts: what remains of a skeleton. Words with a capital, mostly
    names, need a higher share."""

    def __init__(self, common: np.ndarray, capital: np.ndarray, latin: frozenset[int]):
        self.common, self.capital, self.latin = np.sort(common), np.sort(capital), latin

    def masked(self, h: np.ndarray, capital: np.ndarray) -> np.ndarray:
        """Hashes with a hole in place of all that varies."""
        out = np.full(len(h), _HOLE, dtype=np.uint64)
        for known, chosen in ((self.common, ~capital), (self.capital, capital)):
            if len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                keep = chosen & (known[i] == h)
                out[keep] = h[keep]
        out[h == _EDGE] = _EDGE
        return out

    def skeleton(self, tokens: list[str]) -> list[int]:
        h = np.array([_hash(t) for t in tokens], dtype=np.uint64)
        s = self.masked(h, np.array([t[:1].isupper() for t in tokens], dtype=bool)).tolist()
        return [x for k, x in enumerate(s) if x != _HOLE or k == 0 or s[k - 1] != _HOLE]


def _repeats(unit: str) -> bool:
    words = unit.split(None, 8)
    if len(words) < 5 or words[2].lower() not in (words[0].lower(), words[1].lower()):
        return False
    words = unit.split()
    return len({w.lower().strip(".,") for w in words}) <= (1 if len(words) < 8 else 2)


def phrase_hits(unit: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every known phrase in a unit, one for each alternative that occurs."""
    finder, always = _finder()
    low = unit.lower()
    seen = {n for _, numbers in finder.iter(low) for n in numbers} | always
    if not unit.isascii() and _RARE.search(unit):
        seen.update(range(len(phrases())))
    out = [(phrases()[n][0], m.start(), m.end()) for n in sorted(seen) if (m := phrases()[n][1].search(unit))]
    return out + ([("filler", 0, 0)] if _repeats(unit) else [])


def hits(unit: str) -> list[tuple[str, str, bool, int, int]]:
    """(kind, value, known, start, end) of all that may be residue in a unit: marks and known phrases."""
    out = [(k, re.sub(r"\d+", "0", unit[a:b].lower()), True, a, b) for k, a, b in phrase_hits(unit)]
    if _ODD.search(unit):
        spots = {}
        for m in SLOT.finditer(unit):
            spots[m.span()] = True
        for m in MARK.finditer(unit):
            if not any(a < m.end() and m.start() < b for a, b in spots):
                spots[m.span()] = False
        out += [("slot", re.sub(r"\s+", "", unit[a:b]), known, a, b) for (a, b), known in sorted(spots.items())]
    return out


def _word_rows(filter_bits: int):
    """Counts of words by task (kind w: hash, texts, texts beside filler Latin; kind n: texts), and the places
    in the filter of the contexts of all marks (kind b)."""
    latin = {_hash(w) for w in LATIN}

    def run(batches):
        for batch in batches:
            n, near, bits, texts = Counter(), Counter(), set(), 0
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                texts += 1
                own = set(map(_hash, set(_TOKEN_PLAIN.findall(text.lower()))))
                n.update(own)
                if len(own & latin) >= 2:
                    beside: set[int] = set()
                    for u in units(text):
                        words = {_hash(w) for w in _WORD.findall(u)}
                        if len(words & latin) >= 2:
                            beside |= words
                    near.update(beside)
                if _ODD.search(text):
                    for u in units(text):
                        for m in MARK.finditer(u) if _ODD.search(u) else ():
                            keys = _aligned(m[0], [_hash(t) for t in tokens_of(u[: m.start()])], [_hash(t) for t in tokens_of(u[m.end() :])])
                            bits.update(k >> 1 & ((1 << filter_bits) - 1) for k in keys)
            words = list(n)
            count = np.array([n[w] for w in words], dtype=np.int64)
            beside = np.array([near[w] for w in words], dtype=np.int64)
            hashes = np.array(words, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["w"] * len(words) + ["n"] + ["b"] * len(bits)),
                    pa.array(np.r_[hashes, 0, np.array(sorted(bits), dtype=np.int64)].astype(np.int64)),
                    pa.array(np.r_[count, texts, np.ones(len(bits))].astype(np.int64)),
                    pa.array(np.r_[beside, np.zeros(len(bits) + 1)].astype(np.int64)),
                ],
                names=["what", "hash", "n", "near"],
            )

    return run


_LONG, _BIN = pa.list_(pa.int64()), pa.list_(pa.binary())
_HIT = pa.struct([("unit", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("known", pa.bool_()), ("prose", pa.bool_()), ("rest", pa.int64()), ("contexts", _LONG), ("aligned", _LONG)])
_HITS = "array<struct<unit:int,kind:string,value:string,known:boolean,prose:boolean,rest:bigint,contexts:array<bigint>,aligned:array<bigint>>>"


def _signed(values) -> list[int]:
    return np.array(values, dtype=np.uint64).view(np.int64).tolist()


def _hit(number: int, kind: str, value: str, known: bool) -> dict:
    return {"unit": number, "kind": kind, "value": value, "known": known, "prose": False, "rest": 0, "contexts": [], "aligned": []}


def _hit_rows(number: int, unit: str, vocabulary: Vocabulary) -> list[dict]:
    """The hits of a unit with their contexts: ``contexts`` in the skeleton, not at an end of the unit, to tell own text by;
    ``aligned`` in the plain words, to tell slots by (two-sided ones even, one-sided ones odd)."""
    out = []
    for kind, value, known, a, b in hits(unit):
        left, right = tokens_of(unit[:a]), tokens_of(unit[b:])
        row = _hit(number, kind, value, known)
        l, r = vocabulary.skeleton(left), vocabulary.skeleton(right)
        row["rest"] = _signed([_chain_one(9, [*l, _SLOT, *r])])[0]
        before, after = len(_WORD.findall(unit[:a])), len(_WORD.findall(unit[b:]))
        row["prose"] = kind != "slot" and min(before, after) >= 3 and len(_WORD.findall(unit)) >= 10
        if left and right:
            row["contexts"] = _signed(_around(l, r)[0][:3])
        if kind == "slot":
            row["aligned"] = _signed(_aligned(unit[a:b], [_hash(t) for t in left], [_hash(t) for t in right]))
        out.append(row)
    return out


def _looker(vocabulary: Column, filter_bits: int):
    """(id, key, units, hits, plain, plain_n) of each text: keys of its skeletons and its hits; at the last text of a batch, the
    contexts of marks that the batch has with something else in them, with the number of its texts."""

    def run(batches):
        import xxhash

        known, marked = vocabulary.value
        for whole in batches:
            plain: list[np.ndarray] = []
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, flat, sizes, owner = [], [], [], []
                for t in batch.column("text").to_pylist():
                    us = units(t) if t else []
                    found = [h for k, u in enumerate(us) for h in _hit_rows(k, u, known)]
                    rows.append((xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) if t else None, found))
                    for u in us:
                        tokens = tokens_of(u)
                        flat += tokens
                        sizes.append(len(tokens))
                    owner.append(len(us))
                keys, found, latin = _aligned_places(flat, np.array(sizes, dtype=np.int64), np.repeat(np.arange(len(owner)), owner), known, marked, filter_bits)
                plain.append(found)
                ends = np.cumsum(owner)
                for u in np.flatnonzero(latin):
                    j = int(np.searchsorted(ends, u, side="right"))
                    rows[j][1].append(_hit(int(u - ends[j] + owner[j]), "latin", "", True))
                last = at + 256 >= whole.num_rows
                # what is between the words of a mark's context is only asked for up to ``least`` texts: counts of the batch, at its end
                context, n = np.unique(np.concatenate(plain), return_counts=True) if last else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
                cut = np.r_[np.zeros(batch.num_rows), len(context)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array([k for k, _ in rows], pa.binary()),
                        pa.array([keys[e - n : e] for e, n in zip(ends, owner)], _BIN),
                        pa.array([f for _, f in rows], pa.list_(_HIT)),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(context.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(n)),
                    ],
                    names=["id", "key", "units", "hits", "plain", "plain_n"],
                )

    return run


def _aligned_places(flat: list[str], sizes: np.ndarray, owner: np.ndarray, vocabulary: Vocabulary, marked: np.ndarray, filter_bits: int):
    """Skeleton keys of all units; the contexts that the filter knows, once for each text (``owner`` of the units); and
    whether at least half of a unit's words are filler Latin."""
    if not len(flat):
        return [b""] * len(sizes), np.zeros(0, dtype=np.uint64), np.zeros(len(sizes), dtype=bool)
    coded = pa.array(flat, pa.string()).dictionary_encode()
    each = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy()
    h = np.array([_hash(t) for t in each], dtype=np.uint64)[index]
    capital = np.array([t[:1].isupper() for t in each], dtype=bool)[index]
    unit = np.repeat(np.arange(len(sizes)), sizes)
    # skeletons
    s = vocabulary.masked(h, capital)
    first = np.r_[True, unit[1:] != unit[:-1]]
    keep = (s != _HOLE) | first | np.r_[True, s[:-1] != _HOLE]
    u, s = unit[keep], s[keep]
    start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    place = (np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)]))).astype(np.uint64)
    fixed = np.bincount(u, weights=s != _HOLE, minlength=len(sizes))
    keys = np.zeros((len(sizes), 2), dtype=np.uint64)
    keys[u[start], 0] = np.add.reduceat(_mix(s + place * _GOLD), start)
    keys[u[start], 1] = np.add.reduceat(_mix(s * _GOLD + place * _SPLIT2 + np.uint64(77)), start)
    raw = keys.tobytes()
    skeletons = [raw[16 * k : 16 * k + 16] if fixed[k] else b"" for k in range(len(sizes))]
    # places, three ends between any two units
    gap = np.arange(len(flat)) + 3 * (unit + 1)
    t = np.full(len(flat) + 3 * (len(sizes) + 2), _EDGE, dtype=np.uint64)
    t[gap] = h
    before1, before2, before3, after1, after2, after3 = (t[gap + k] for k in (-1, -2, -3, 1, 2, 3))
    solid = h != _SLOT
    found, units_ = [], []
    mask = np.uint64((1 << filter_bits) - 1)

    def emit(kind: int, ok: np.ndarray, odd: int, *parts: np.ndarray) -> None:
        for p in parts:
            ok = ok & (p != _SLOT)
        key = _chain(kind, *parts)
        ok = ok & marked[(key >> np.uint64(1) & mask).astype(np.int64)]
        found.append(key[ok] & ~np.uint64(1) | np.uint64(odd))
        units_.append(unit[ok])

    emit(1, solid, 0, before2, before1, after1)  # a word between
    emit(2, solid, 0, before1, after1, after2)
    emit(1, solid, 0, before2, before1, h)  # nothing between
    emit(2, solid, 0, before1, h, after1)
    alpha = np.array([t[:1].isalpha() for t in each], dtype=bool)
    words = np.bincount(unit, weights=alpha[index], minlength=len(sizes))
    filler = np.bincount(unit, weights=(alpha & np.array([_hash(t) in vocabulary.latin for t in each], dtype=bool))[index], minlength=len(sizes))
    word = solid & np.array([t[:1].isalnum() for t in each], dtype=bool)[index]
    emit(5, word, 1, before2, before1, after1)  # a word where a gap may be
    emit(6, word, 1, before1, after1, after2)
    emit(3, solid, 1, before3, before2, before1)
    emit(4, solid, 1, after1, after2, after3)
    found, text = np.concatenate(found), owner[np.concatenate(units_)]
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return skeletons, found[fresh], (words >= 4) & (2 * filler >= words)


def find_residue(
    df: DataFrame,
    id_col: str,
    text_col: str,
    least_records: int = 5,
    least_pages: int = 4,
    template_share: float = 3e-5,
    page_share: float = 0.6,
    word_share: float = 2.5e-4,
    name_share: float = 1e-3,
    filter_bits: int = 24,
    seeds: bool = True,
) -> DataFrame:
    """(id, kind) for every row of ``df``: kind is slot, page, latin, filler, value, scripts, message or null for none.

    A skeleton is what a unit has of words in at least ``word_share`` of all texts (with a capital: ``name_share``, and
    four). It is a page's if at least ``least_pages`` and ``template_share`` of all texts have it and consist of skeletons that are
    so frequent, and these are at least ``page_share`` of all that have it. A mark is own text if at least ``least_records`` texts whose skeletons differ in the rest (half of all
    such texts, or four times as many) have it between the same words, and at most a tenth as many have another; a
    slot if other records have something else there; otherwise its spelling decides. A known phrase that no other
    record has between the same words is own text inside a sentence of ten words or more. Without ``seeds``, known phrases and
    spellings count for nothing, and alignment alone decides. Null and empty texts have no residue;
    equal texts get equal kinds; an empty table gives an empty result. Other columns of ``df`` are dropped.

    Only the words over ``word_share`` reach the driver and the tasks, at most the mean number of different words of a text divided by
    that share, and ``2 ** filter_bits`` bits that tell which contexts a mark has anywhere (others need not be shuffled).
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = df.sparkSession
    counted = written(texts.select("text").mapInArrow(_word_rows(filter_bits), "what string, hash long, n long, near long"), "words")
    total = counted.filter("what = 'n'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = (
        counted.filter("what = 'w'").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))
        .filter(F.col("n") >= total * word_share).toArrow()
    )
    hashes, n, near = (words.column(c).to_numpy() for c in ("hash", "n", "near"))
    latin = frozenset(hashes[(near >= 3) & (5 * near >= n)].view(np.uint64).tolist()) | {_hash(w) for w in LATIN}
    common = Vocabulary(hashes.view(np.uint64), hashes[n >= max(4, total * name_share)].view(np.uint64), latin)
    marked = np.zeros(1 << filter_bits, dtype=bool)
    marked[counted.filter("what = 'b'").select("hash").distinct().toArrow().column("hash").to_numpy()] = True
    shared = spark.sparkContext.broadcast((common, marked))

    kind = dict(texts.dtypes)["id"]
    looked = written(
        texts.mapInArrow(_looker(shared, filter_bits), f"id {kind}, key binary, units array<binary>, hits {_HITS}, plain array<bigint>, plain_n array<bigint>"), "looked"
    )
    least = max(least_pages, int(np.ceil(total * template_share)))
    verdicts = (
        page_texts(looked, least, page_share).select("key", F.lit("page").alias("kind"))
        .unionByName(hit_texts(looked, least_records, seeds))
        .groupBy("key").agg(F.min("kind").alias("kind"))
    )
    return looked.select("id", "key").join(verdicts, "key", "left").select("id", "kind")


def page_texts(looked: DataFrame, least: int, page_share: float) -> DataFrame:
    """(key) of the texts with a line of a page that is nothing but template."""
    pairs = written(looked.filter("key is not null").select("key", F.explode("units").alias("unit")).distinct(), "skeletons")
    stock = pairs.filter("unit <> X''").groupBy("unit").agg(F.count("*").alias("texts")).filter(F.col("texts") >= least)
    counted = written(pairs.join(stock, "unit", "left"), "counted")
    whole = counted.groupBy("key").agg(F.bool_and(F.col("texts").isNotNull() | (F.col("unit") == F.lit(b""))).alias("whole"))
    pages = (
        counted.filter("texts is not null").join(whole, "key")
        .groupBy("unit").agg(F.count("*").alias("all"), F.count_if("whole").alias("whole"))
        .filter((F.col("whole") >= page_share * F.col("all")) & (F.col("whole") >= least))
        .select("unit")
    )
    return counted.join(pages, "unit", "left_semi").select("key").distinct()


def hit_texts(looked: DataFrame, least: int, seeds: bool = True) -> DataFrame:
    """(key, kind) of the texts with a mark in a slot, or a known phrase, that is not their template's own text."""
    hit = written(looked.filter("size(hits) > 0").select("key", F.posexplode("hits").alias("no", "h")).select("key", "no", "h.*").distinct(), "hits")
    around = hit.select("key", "no", "value", "rest", F.explode("contexts").alias("context"))
    same = (
        around.groupBy("context", "value").agg(F.count_distinct("key").alias("n"), F.count_distinct("rest").alias("rests"))
        .groupBy("context").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("rests").alias("rests"))
    )
    told = around.join(same, "context").groupBy("key", "no").agg(
        F.bool_or((F.col("rests") >= least) & ((2 * F.col("rests") >= F.col("n")) | (F.col("rests") >= 4 * least)) & (10 * F.col("most") >= 9 * F.col("n"))).alias("own"),
        F.bool_or((F.col("n") > 1) & (10 * F.col("most") < 9 * F.col("n"))).alias("varies"),
        F.max("n").alias("records"),
    )
    plain = (
        looked.filter("size(plain) > 0").select(F.explode(F.arrays_zip("plain", "plain_n")).alias("p"))
        .groupBy(F.col("p.plain").alias("context")).agg(F.sum("p.plain_n").alias("others"))
    )
    slots = (
        hit.select("key", "no", F.explode("aligned").alias("context")).join(plain, "context")
        .groupBy("key", "no").agg(F.bool_or((F.col("context") % 2 == 0) | (F.col("others") >= least)).alias("slot"))
    )
    judged = hit.join(told, ["key", "no"], "left").join(slots, ["key", "no"], "left")
    own = F.coalesce("own", F.lit(False)) | F.col("prose") & (F.coalesce("records", F.lit(1)) == 1)
    aligned = (F.col("kind") == "slot") & (F.coalesce("slot", F.lit(False)) | F.coalesce("varies", F.lit(False)))
    known = F.col("known") & F.lit(seeds)
    return judged.filter(~own & (known | aligned)).select("key", "kind")
