"""Text as Column expressions: words, sentences, numbers, shapes, markup. Characters are code points; case folding is ASCII only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is made of letters, apostrophes, hyphens and what is not ASCII; digits are no part of it.
WORD = r"[a-z'\-\x{80}-\x{10FFFF}]+"
PURE = r"[a-z\x{80}-\x{10FFFF}]+"
#: Letters and digits make the tokens of the second kind; a point may follow a digit, and is set as \x01 before they are taken.
#: (One class and no repeated group: the JVM's regular expressions recurse over repeated groups.)
TOKEN = r"[a-z0-9\x{1}\x{80}-\x{10FFFF}]+"
NUMBER = r"[0-9]+"
TAG = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|</?[A-Za-z][^>]*>"
#: Abbreviations by language.
ABBREVIATIONS = {"en": ("mr", "mrs", "ms", "dr", "st", "jr"), "fr": ("m", "mm"), "de": ("fr", "hr", "hrn")}


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    return extract(fold(text), WORD)


def _pointed(text: Column) -> Column:
    return F.regexp_replace(fold(text), r"([0-9])\.", "$1\x01")


def tokens(text: Column) -> Column:
    return F.transform(extract(_pointed(text), TOKEN), lambda t: F.translate(t, "\x01", "."))


def keywords(text: Column) -> Column:
    """Tokens right before : or =."""
    return F.transform(extract(_pointed(text), rf"({TOKEN})[:=]", 1), lambda t: F.translate(t, "\x01", "."))


def topics(text: Column) -> Column:
    """The last word before each colon."""
    return extract(fold(text), rf"({WORD})[^a-z'\-:\x{{80}}-\x{{10FFFF}}]*:", 1)


def expressions(text: Column) -> Column:
    """Runs of pure words with nothing but white space between them."""
    return F.filter(extract(fold(text), r"[a-z \t\r\n\x{80}-\x{10FFFF}]+"), lambda e: e.rlike(r"[^ \t\r\n]"))


def pairs(items: Column) -> Column:
    """Neighbours in an array: struct(a, b)."""
    n = F.size(items)
    return F.when(n > 1, F.arrays_zip(F.slice(items, F.lit(1), n - 1).alias("a"), F.slice(items, F.lit(2), n - 1).alias("b"))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def abbreviated(text: Column, lang: Column) -> Column:
    """Points that end a capitalised abbreviation of the language: no sentence ends there."""
    out = F.lit(0)
    for name, known in ABBREVIATIONS.items():
        listed = "|".join(w.capitalize() for w in known)
        out = F.when(lang == name, count_of(text, rf"(?:^|[^A-Za-z'\-\x{{80}}-\x{{10FFFF}}])(?:{listed})\.")).otherwise(out)
    return out


def numbers(text: Column) -> Column:
    """Positive whole numbers, of long runs of digits the last 18."""
    found = F.transform(extract(text, NUMBER), lambda d: F.right(d, F.lit(18)).cast("bigint"))
    return F.filter(found, lambda x: x > 0)


def shape(text: Column) -> Column:
    """Runs of digits, capitals, small letters and non-ASCII characters as one 0, A, a and x; the rest stays."""
    for pattern, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), (r"[\x{80}-\x{10FFFF}]+", "x")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def ends_within(word: Column, suffix: str) -> Column:
    """Ends with a suffix and is longer than it."""
    return word.endswith(suffix) & (F.octet_length(word) > len(suffix.encode()))


def starts_within(word: Column, prefix: str) -> Column:
    return word.startswith(prefix) & (F.octet_length(word) > len(prefix.encode()))


#: What makes the flags of a content, lowest bit first.
CONTENT = (
    ("text", r"^[\x{0}-\x{7F}]{8,}$"),
    ("number", r"[0-9]$"),
    ("date", r"[0-9]{4}[-.][0-9]{1,2}[-.][0-9]{1,2}$|[0-9]{1,2}[-.][0-9]{1,2}[-.][0-9]{4}$"),
    ("time", r"(?:^|[^0-9:])[0-9]{2}:[0-9]{2}(?::[0-9]{2})?$"),
    ("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://"),
    ("coordinates", r"[0-9]{1,2}\x{B0}[0-9]{2}'"),
    ("temperature", r"[0-9] ?\x{B0}[A-FH-Z]$"),
    ("isbn", r" ISBN"),
)


def content_flags(text: Column) -> Column:
    out = F.lit(0)
    for k, (_, pattern) in enumerate(CONTENT):
        out = out + F.when(text.rlike(pattern), F.lit(1 << k)).otherwise(F.lit(0))
    return out
