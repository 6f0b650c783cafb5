"""Text expressions: normalisation, tokens, sentences, words in common."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.stemmer import stem

# Token pattern, stop words of search, stop words of claims, sentence break.
TOKEN = r"[a-z0-9]+(?:[.,'\-][a-z0-9]+)*"
STOPWORDS = (
    "a an and are as at be been but by for from had has have how in into is it its of on or our than that the their there these this those to "
    "was were what when where which while who why will with within would we you your company company's"
).split()
CLAIM_STOPWORDS = (
    "the and for with from that this was were are its their which while also into than over under per has had have been being about after before "
    "between during fiscal year years total company compared primarily due including other our approximately respectively increased decreased "
    "increase decrease reported prior billion million thousand percent"
).split()
SENTENCE_BREAK = r"(?<=[.!?;])\s+(?=[A-Z0-9(\"“$•])"
CLAIM_WORD = r"[a-z][a-z&'-]{2,}"


def normalize_ws(c: Column) -> Column:
    """Runs of white space of any kind become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_quotes(c: Column) -> Column:
    """Curly quotes, dashes and no-break spaces become plain; white space collapses."""
    return normalize_ws(F.translate(c, "’‘“”–— ", "''\"\"-- "))


def raw_tokens(c: Column) -> Column:
    """Lower-case tokens without stop words, unstemmed."""
    found = F.regexp_extract_all(F.lower(F.replace(c, F.lit("’"), F.lit("'"))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


@lru_cache(maxsize=200_000)
def _stem(token: str) -> str:
    return stem(token) if token.isalpha() else token


def _stem_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else [_stem(t) for t in x])


def _stem_each(words: pd.Series) -> pd.Series:
    return words.map(_stem.__wrapped__)  # distinct words: nothing to remember


def tokens(c: Column, stemmed: bool = True) -> Column:
    """The search tokens of a text; alphabetic ones stemmed (the one step outside the JVM)."""
    raw = raw_tokens(c)
    return F.pandas_udf(_stem_all, "array<string>")(raw) if stemmed else raw


def stemmed_token(c: Column) -> Column:
    """The search token of one lower-case word. Not deterministic in name only: else the optimizer pushes a semi join with
    tokens, and the stemming with it, below the distinct that makes the words few."""
    return F.pandas_udf(_stem_each, "string").asNondeterministic()(c)


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, SENTENCE_BREAK), lambda s: s != "")


def segments(c: Column) -> Column:
    """Sentences and table rows: where a figure is stated."""
    return F.filter(F.split(c, r"\n|(?<=[.;])\s+"), lambda s: F.trim(s) != "")


def content_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(CLAIM_WORD), F.lit(0)), lambda w: ~w.isin(CLAIM_STOPWORDS)))


def overlap(claim: Column, source: Column) -> Column:
    """Share of the claim's content words found in the source; 0 without words."""
    words = content_words(claim)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, content_words(source))), F.size(words)), F.lit(0.0))


def stems5(words: Column) -> Column:
    """Crude stems: the first five letters of alphabetic words."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike("^[a-z]+$")), lambda w: F.left(w, F.lit(5))))


def highlight_terms(query: Column) -> Column:
    """Words of a query worth marking in a passage."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"[a-z0-9][a-z0-9'-]*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)))


def content_hash(c: Column) -> Column:
    """Sixteen hex digits that change with the text."""
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def word_count(c: Column) -> Column:
    """The default token counter."""
    return F.size(F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda w: w != ""))
