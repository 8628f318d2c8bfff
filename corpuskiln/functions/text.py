"""Column expressions on text. All stay inside the JVM; null gives null unless said otherwise."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskiln import config


def strip(text: Column) -> Column:
    """Without white space at both ends (Spark's own trim takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_lines(text: Column) -> Column:
    """Each line stripped, then the whole."""
    return strip(F.array_join(F.transform(F.split(text, "\n"), strip), "\n"))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; a final sigma counts as any sigma."""
    return F.filter(F.split(F.translate(F.lower(text), "ς", "σ"), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def not_blank(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def doc_id(source_file: Column, raw: Column) -> Column:
    """SHA-256 of the path, '::' and the raw bytes, these read as Latin-1 and written as UTF-8."""
    as_text = F.encode(F.decode(raw, "ISO-8859-1"), "UTF-8")
    return F.sha2(F.concat(F.encode(source_file, "UTF-8"), F.encode(F.lit("::"), "UTF-8"), as_text), 256)


def chunk_id(parent: Column, index: Column) -> Column:
    return F.concat_ws(":", parent, index.cast("string"))


def cache_key(query: Column) -> Column:
    return F.sha2(strip(F.lower(query)), 256)


def is_refusal(answer: Column, refusal: str = config.REFUSAL) -> Column:
    """Whether the answer is the refusal but for case and white space; false for null and empty answers."""
    plain = F.lower(strip(F.regexp_replace(answer, r"\s+", " ")))
    return F.coalesce((answer == refusal) | (plain == F.lit(refusal.lower())), F.lit(False))


def citation_markers(answer: Column) -> Column:
    """Distinct numbers of markers like [1] or 【2†L1】 in order of first occurrence; empty for null."""
    found = F.regexp_extract_all(answer, F.lit(r"[\[【](\d+)[^\]】]*[\]】]"), F.lit(1))
    numbers = F.filter(F.transform(found, lambda m: m.try_cast("int")), lambda n: n.isNotNull())
    return F.coalesce(F.array_distinct(numbers), F.array().cast("array<int>"))


def title_of(text: Column) -> Column:
    """What follows 'Title:' in the first line, else an empty string."""
    return F.coalesce(F.regexp_extract(F.split(text, "\n")[0], r"(?i)^\s*title:\s*(.*?)\s*$", 1), F.lit(""))


def clean_question(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), '^"+|"+$', ""))


def verdict_is_none(verdict: Column) -> Column:
    """Whether a judge found no unsupported claim."""
    return F.upper(strip(F.replace(verdict, F.lit("."), F.lit("")))) == "NONE"


def snippet(text: Column, chars: int = 180) -> Column:
    """The beginning of a text for a report."""
    return F.left(text, F.lit(chars))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def title_matches(title: Column, keywords: tuple[str, ...] = config.TITLE_KEYWORDS) -> Column:
    """Whether a title has one of the keywords as words, also in the plural with s."""
    any_of = "|".join(re.escape(k).replace("\\ ", " ") for k in keywords)
    return F.coalesce(title.rlike(rf"(?i)\b(?:{any_of})s?\b"), F.lit(False))


def file_type(path: Column) -> Column:
    """txt, pdf, html or md by the suffix; null for other files."""
    suffix = extension(path)
    return F.when(suffix.isin("txt", "pdf", "md"), suffix).when(suffix.isin("html", "htm"), F.lit("html"))


# What separates text nodes.
_MARKUP = r"(?is)(?:<!--.*?-->|<!doctype[^>]*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>)+"


def _decoded(text: Column) -> Column:
    """Named and numbered entities as characters."""

    @F.arrow_udf("string")
    def unescape(texts: pa.Array) -> pa.Array:
        return pa.array([html.unescape(t) if t and "&" in t else t for t in texts.to_pylist()], type=pa.string())

    return unescape(text)


def html_text(page: Column) -> Column:
    """Text nodes of a page, one per line, without scripts and styles; lines and the whole stripped."""
    return strip_lines(_decoded(F.regexp_replace(page, _MARKUP, "\n")))


def html_title(page: Column) -> Column:
    """Text of the title element; null if there is none or it is blank."""
    title = strip(_decoded(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))
    return F.when(title != "", title)


def markdown_text(source: Column) -> Column:
    """Text of a Markdown file as lines, without code (fenced, indented by a fence, or inline) and markup."""
    text = F.regexp_replace(source, r"(?ms)^[ \t]*(```|~~~).*?^[ \t]*\1[ \t]*$", "")
    text = F.regexp_replace(text, r"`+[^`\n]+`+", "\n")
    text = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "\n$1\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]{0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d+[.)][ \t]+)", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:[-*_][ \t]*){3,}$|^[ \t]*\|?[ \t:|-]+\|[ \t:|-]*$", "")
    text = F.regexp_replace(text, r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", "\n$2\n")
    text = F.regexp_replace(text, r"(?m)[ \t]+#+[ \t]*$", "")
    return html_text(text)
