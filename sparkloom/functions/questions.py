"""Column functions that read questions: phrases, terms, exclusions, synonyms, intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T

#: Words that a question may hold without asking for them.
STOP = [
    "the", "and", "for", "with", "what", "which", "that", "this", "from", "into", "does", "are", "how", "why", "when", "where", "between", "about", "of", "to",
    "is", "a", "an", "in", "on",
]
#: Short forms and what they stand for.
SYNONYMS = {
    "rrf": "reciprocal rank fusion", "knu": "knowledge unit", "ctx": "context", "atm": "atom", "con": "concept",
    "exh": "exhibition", "fts": "full text search", "bm25": "okapi bm25", "knn": "nearest neighbor",
}
#: The parts of a question that give its intent away, tried in this order.
INTENTS = [
    ("definition", ["what is", "define", "definition of", "무엇", "이란", "란 "]),
    ("comparison", [" vs ", "versus", "compare", "difference between", "차이"]),
    ("procedure", ["how to", "how do", "steps to", "방법", "어떻게"]),
]
#: Scripts without blanks, signs at a word's edges, and signs that a match string gives another meaning.
EAST_ASIAN = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"
EDGE = r"""[.,;:!?'"()\[\]{}]+"""
SPECIAL = r'[":()*^]'


def bare(word: Column) -> Column:
    """A word without punctuation at its edges."""
    return F.regexp_replace(word, f"^{EDGE}|{EDGE}$", "")


def said(words: Column) -> Column:
    """Words that are left of a list once their edges are bare."""
    return F.filter(F.transform(words, bare), lambda w: w != "")


def phrases(question: Column) -> Column:
    """What stands in double quotes."""
    return F.filter(F.transform(F.regexp_extract_all(question, F.lit('"([^"]+)"'), 1), lambda x: F.trim(x)), lambda p: p != "")


def unquoted(question: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(question, '"[^"]+"', " "), r"\s+"), lambda w: w != "")


def is_minus(word: Column) -> Column:
    return word.rlike("^-.")


def excluded(question: Column) -> Column:
    """The different words with a minus before them; a second minus belongs to the word."""
    return F.array_distinct(said(F.transform(F.filter(unquoted(question), is_minus), lambda w: F.regexp_replace(w, "^-", ""))))


def matters(word: Column) -> Column:
    """Identifiers and words of other scripts always do; others unless they are stop words or of two letters that aren't capitals."""
    identifier, foreign = word.rlike(r"[.\-_/]"), word.rlike(r"[^\x00-\x7F]")
    capitals = word.rlike("[A-Z]") & (F.upper(word) == word)
    return identifier | foreign | ~(F.lower(word).isin(STOP) | (F.length(word) <= 2) & ~capitals)


def terms(question: Column) -> Column:
    """The different words that are asked for, in their order."""
    return F.array_distinct(F.filter(said(F.filter(unquoted(question), lambda w: ~is_minus(w))), matters))


def east_asian(text: Column) -> Column:
    return text.rlike(EAST_ASIAN)


def match_string(question: Column, trigrams: bool = False) -> Column:
    """Phrases, then one of the terms at least (as beginnings of words), without the exclusions.

    Signs with a meaning of their own become blanks. Identifiers, phrases and
    exclusions are quoted. Trigrams know no beginnings and nothing under three
    letters, and quote all.
    """
    quoted = lambda w: F.concat(F.lit('"'), w, F.lit('"'))
    kept = lambda words: F.filter(F.transform(words, lambda w: F.trim(F.regexp_replace(w, SPECIAL, " "))), lambda w: F.length(w) >= (3 if trigrams else 1))
    begun = lambda w: F.concat(F.when(w.rlike(r"[.\-_/]"), quoted(w)).otherwise(w), F.lit("*"))
    some = F.transform(kept(terms(question)), quoted if trigrams else begun)
    any_of = F.when(F.size(some) > 0, F.concat(F.lit("("), F.array_join(some, " OR "), F.lit(")")))
    every = F.concat_ws(" ", F.transform(kept(phrases(question)), quoted), any_of)
    none_of = F.array_join(F.transform(kept(excluded(question)), lambda w: F.concat(F.lit(" NOT "), quoted(w))), "")
    return F.trim(F.concat(every, none_of))


def intent(question: Column) -> Column:
    low, out = F.lower(question), F.lit("default")
    for name, cues in reversed(INTENTS):
        hit = F.lit(False)
        for cue in cues:
            hit = hit | low.contains(cue)
        out = F.when(hit, name).otherwise(out)
    return out


def synonyms(question: Column) -> Column:
    """What the terms that are short forms stand for."""
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(terms(question), lambda t: F.element_at(known, F.lower(t))), lambda t: t.isNotNull()))


def fallback_terms(text: Column) -> Column:
    """Terms of a message for which there is no better reading: words of any script, without single characters."""
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_./+-]+", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: F.length(w) > 1), " ")


def wanted_tokens(word: Column) -> Column:
    """The index tokens of a phrase or a term."""
    return T.index_tokens(word)
