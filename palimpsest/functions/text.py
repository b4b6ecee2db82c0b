"""Terms of texts, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree on which words are left out, where texts are cut, and which suffixes go.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to",
    "was", "were", "will", "with", "but", "not", "or", "this", "have", "had", "what", "when", "where", "who", "which", "why", "how",
]
BREAKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}!-/:-@\[-`{-~]+"
SHORTEST, LONGEST = 2, 50
#: (suffix, least bytes of a term that loses it, bytes lost, whether the second of a doubled last letter goes too); the
#: first suffix that fits counts.
SUFFIXES = [("ing", 5, 3, True), ("ed", 5, 2, True), ("er", 5, 2, True), ("est", 6, 3, False), ("ly", 6, 2, False), ("tion", 7, 3, False), ("sion", 7, 3, False)]


def stem(term: Column) -> Column:
    """The term without its suffix."""

    def rule(rest: Column, suffix: tuple) -> Column:
        end, least, lost, doubled = suffix
        body = F.substring(term, F.lit(1), F.length(term) - lost)
        if doubled:
            body = F.regexp_replace(body, r"([\x00-\x7F])\1$", "$1")
        return F.when(term.endswith(end) & (F.octet_length(term) >= least), body).otherwise(rest)

    return reduce(rule, reversed(SUFFIXES), term)


def terms(text: Column, stemmed: bool = False, stop_words: bool = True) -> Column:
    """The terms of a text, in order: lower-cased, of 2 to 50 bytes, without stop words."""

    def good(t: Column) -> Column:
        ok = (F.octet_length(t) >= SHORTEST) & (F.octet_length(t) <= LONGEST)
        return ok & ~t.isin(STOP_WORDS) if stop_words else ok

    out = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), good)
    return F.transform(out, stem) if stemmed else out
