"""Text functions as Column expressions.

Regular expressions carry (?U) where Unicode classes are meant; exact=False drops it
and NFKC, for plans that other engines must reproduce.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.config import STOPWORDS

#: Lexical tokens: fixed values, in order of precedence.
TOKEN = (
    r"§\s*\d+(?:\.\d+)*"
    r"|\$[A-Za-z][A-Za-z0-9]{0,9}(?:\.[A-Za-z0-9]{1,4})?"
    r"|[+-]?\d+(?:,\d{3})*(?:\.\d+)?%"
    r"|[A-Za-z]{1,10}\.[A-Za-z0-9]{1,4}"
    r"|\d+(?:\.\d+)+"
    r"|[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+\+?"
    r"|[A-Za-z]+[A-Za-z0-9]*\+?"
    r"|[+-]?\d+(?:,\d{3})*(?:\.\d+)?"
)
#: The same tokens, found faster: letters that nothing of a longer token follows.
FAST_TOKEN = r"[A-Za-z]++(?![A-Za-z0-9.+\-])|" + TOKEN
#: Words for comparing texts (fixed value).
COMPARED = r"(?U)\w+(?:[.'’/-]\w+)*|[$€£¥₹]|%"
_TOKEN, _SPACE = re.compile(FAST_TOKEN, re.ASCII), re.compile(r"\s+", re.ASCII)
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\[])"
LEGAL_CLAUSE = r"(?i)^\s*(?:section\s+)?\d+(?:\.\d+)+\b"
REFERENCE = r"(?i)\b(?:section|clause|appendix|schedule)\s+[A-Za-z0-9][A-Za-z0-9.\-]*"
RELATION_CUES = ("how ", "why ", "affect", "relationship", "compare", "based on", "according to", "under ")
REFUSALS = ("insufficient context", "not enough context", "not enough evidence", "cannot answer from the provided context", "can't answer from the provided context")
SMALL_TALK = ("hello", "hi", "hey", "thanks", "thank you", "good morning", "good afternoon", "good evening")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def casefold_any(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else t.casefold())


def casefold(text: Column, exact: bool = False) -> Column:
    """Lower case with ß as ss, all that differs in Latin text but for ligatures; exact: Unicode case folding in Python."""
    return casefold_any(text) if exact else F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def table_whitespace(text: Column) -> Column:
    """Spaces within cells to one, tabs and line ends kept."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.translate(c, "\r", " "), r"[ \f\x0B]+", " "), r"(?U)^\s+|\s+$", "")
    row = lambda r: F.array_join(F.transform(F.split(r, "\t"), cell), "\t")
    return F.regexp_replace(F.array_join(F.transform(F.split(text, "\n"), row), "\n"), r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column, kind: Column | None = None, *, form: str = "NFKC", controls: bool = True, hyphens: bool = True, collapse: bool = True, exact: bool = True) -> Column:
    """Unicode form, line ends, control and zero-width characters, hyphenated line ends, white space."""
    out = (nfkc(text) if form == "NFKC" else nfc(text)) if exact else text
    out = F.regexp_replace(out, "\r\n?", "\n")
    if controls:
        out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f­​‌‍﻿]", "")
    if hyphens:
        out = F.regexp_replace(out, r"(?U)(?<=\w)-[ \t]*\n[ \t]*(?=\w)", "")
    if not collapse:
        return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    return squeeze(out) if kind is None else F.when(kind == "table", table_whitespace(out)).otherwise(squeeze(out))


def pattern_signature(text: Column, canonical_pages: bool = True, exact: bool = True) -> Column:
    """A header or footer with what varies by page replaced."""
    out = casefold(squeeze(nfkc(text) if exact else text), exact)
    if not canonical_pages:
        return out
    out = F.regexp_replace(out, r"(?iU)\bpage\s+\d+\s+(?:of|/)\s*\d+\b", "page <page> of <total>")
    out = F.regexp_replace(out, r"(?iU)\bpage\s+\d+\b", "page <page>")
    edge = F.regexp_replace(out, r"(?U)(^|[|—–-]\s*)\d+\s*$", "$1<page>")
    return F.when(out.rlike(r"(?iU)^\s*(?:p(?:age)?\.?\s*)?\d+(?:\s*/\s*\d+)?\s*$"), F.lit("<page-number>")).otherwise(edge)


def is_page_number(text: Column, exact: bool = True) -> Column:
    out = squeeze(nfkc(text) if exact else text)
    return out.rlike(r"(?iU)^(?:\s*(?:p(?:age)?\.?\s*)?\d+(?:\s*/\s*\d+)?\s*|page\s+\d+|page\s+\d+\s+(?:of|/)\s*\d+)$")


def comparison_tokens(text: Column, exact: bool = True) -> Column:
    return F.array_distinct(F.regexp_extract_all(casefold(nfkc(text) if exact else text, exact), F.lit(COMPARED), 0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def starts_legal_clause(text: Column) -> Column:
    return text.rlike(LEGAL_CLAUSE)


def classify_text(text: Column, heading: Column | None = None, top: Column | None = None, bottom: Column | None = None) -> Column:
    """title, header, footer, caption, list_item or text, the first that holds."""
    no, t = F.lit(False), F.regexp_replace(text, r"(?U)^\s+", "")
    return (
        F.when(no if heading is None else heading, "title").when(no if top is None else top, "header").when(no if bottom is None else bottom, "footer")
        .when(t.rlike(r"(?i)^(figure|table)\s+\d+[\s:.-]"), "caption").when(t.rlike(r"^(?:[-*•]\s+|\d+[.)]\s+|[A-Za-z][.)]\s+)"), "list_item").otherwise("text")
    )


def lexical_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Terms for BM25: lower case, § joined to its number, stop words dropped."""
    found = F.transform(F.regexp_extract_all(text, F.lit(FAST_TOKEN), 0), lambda t: F.lower(F.when(t.startswith("§"), F.regexp_replace(t, r"\s+", "")).otherwise(t)))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def token_counts(text: str | None, stopwords: tuple[str, ...] = STOPWORDS) -> Counter:
    """How often each of lexical_tokens() occurs, in Python."""
    found = _TOKEN.findall(text or "")
    if text and "§" in text:
        found = [_SPACE.sub("", t) if t[0] == "§" else t for t in found]
    out = Counter(map(str.lower, found))
    for word in stopwords:
        out.pop(word, None)
    return out


def judge_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def is_small_talk(question: Column) -> Column:
    return F.trim(F.regexp_replace(squeeze(casefold(question)), "[^a-z ]+", "")).isin(*SMALL_TALK)
