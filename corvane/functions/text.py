"""Tokens, sentences, snippets and overlaps of texts."""

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a token of search payloads, and of one of questions and evidence: fixed patterns. Letters and digits of any script.
SEARCH_TOKEN = r"([\p{L}\p{N}_%/.-]+)"
QUERY_TOKEN = r"([A-Za-zА-Яа-яЁё0-9%/.,-]+)"
STRIPPED = ".,;:()[]{}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: as the variable of a lambda it isn't written out wherever it's used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, whatever reads it: the optimiser doesn't write a generator's values out again in filters and later columns."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def tokens(text: Column, pattern: str = SEARCH_TOKEN) -> Column:
    """array<string>: distinct lower-case tokens of two characters or more, points, commas and brackets stripped from their ends."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern))
    stripped = F.transform(found, lambda t: F.btrim(t, F.lit(STRIPPED)))
    return F.array_distinct(F.filter(stripped, lambda t: F.length(t) >= 2))


def overlap(own: Column, others: Column) -> Column:
    """The share of own tokens that are among the others; 0 where either has none."""
    return F.when((F.size(own) == 0) | (F.size(others) == 0), 0.0).otherwise(F.size(F.array_intersect(own, others)) / F.size(own))


def has_token(text: Column, token: str) -> Column:
    """Whether `tokens` of the text has this token, by a search for it and, where it is found, for its ends: no array of all tokens is made."""
    low = F.lower(F.coalesce(text, F.lit("")))
    edge = r"[\p{L}\p{N}_%/.-]"
    return F.contains(low, F.lit(token)) & low.rlike(rf"(?<!{edge})\.*{re.escape(token)}\.*(?!{edge})")


def token_share(text: Column, query: list[str]) -> Column:
    """The share of the query's tokens that the text has."""
    return reduce(lambda a, b: a + b, [has_token(text, t).cast("int") for t in query], F.lit(0)) / float(len(query))


def distinct_in_order(values: Column) -> Column:
    """array<string> without values that equal an earlier one but for case."""
    def kept(own: Column, low: Column) -> Column:
        return F.when(F.size(F.array_distinct(low)) == F.size(own), own).otherwise(F.filter(own, lambda v, i: F.array_position(low, F.lower(v)) == i + 1))

    return let(values, lambda own: let(F.transform(own, lambda v: F.lower(v)), lambda low: kept(own, low)))


def union_in_order(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def flat(text: Column) -> Column:
    """White space made one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\r\\n\\f\\u000B]+", " "))


def snippet(text: Column, most: int = 180) -> Column:
    """White space collapsed; a text beyond `most` characters is cut and ends in three points."""
    one = flat(text)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, most - 3)), F.lit("...")))


def sentences(text: Column, least: int = 8) -> Column:
    """array<string>: parts after a point, ! ? or 。 and white space, without blanks and semicolons at their ends; those of `least` characters or more."""
    parts = F.split(flat(text), r"(?<=[.!?。])\s+")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" ;"))), lambda p: F.length(p) >= least)


def alias_form(text: Column) -> Column:
    """Lower case, one kind of dash, white space made one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "–—‑", "---"), r"\s+", " "))
