"""Numbers, years, snippets, chunks and file names out of texts."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: what counts as a number, a range of years and a year.
NUMBER = r"([-+]?[0-9]+(?:[,.][0-9]+)?)"
YEAR_RANGE = r"20[0-9][0-9]\s*[-–—]\s*20[0-9][0-9]"
YEAR = r"(?=2)(?U)\b20[0-9][0-9]\b"


def numbers(text: Column) -> Column:
    """array<double> in order of appearance; a decimal comma counts as a point."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER))
    return F.transform(found, lambda x: F.replace(F.replace(x, F.lit(","), F.lit(".")), F.lit("+"), F.lit("")).try_cast("double"))


def periods(text: Column) -> Column:
    """array<struct<start_year, end_year>>, distinct and in order: ranges of years if there are any, else single years."""
    body = F.coalesce(text, F.lit(""))
    year = lambda x, at: F.substring(x, at, 4).cast("int")
    span = lambda x: F.struct(year(x, 1).alias("start_year"), year(x, -4).alias("end_year"))
    ranges = F.regexp_extract_all(body, F.lit(YEAR_RANGE), F.lit(0))
    return F.array_distinct(F.transform(F.when(F.size(ranges) > 0, ranges).otherwise(F.regexp_extract_all(body, F.lit(YEAR), F.lit(0))), span))


#: Characters that an answer grows by from one message to the next: a fixed value.
CHUNK = 48


def chunks(text: Column, size: int = CHUNK) -> Column:
    """array<string>: the text in pieces of `size` characters, in one linear pass."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(.{{1,{size}}})"))


def messages(text: Column, size: int = CHUNK) -> Column:
    """array<struct<at, piece>>: the pieces of an answer with the place of each; a reader that joins them has seen the text up to there. Linear in the text."""
    return F.transform(chunks(text, size), lambda c, i: F.struct((i * size).alias("at"), c.alias("piece")))


def repaired(text: Column) -> Column:
    """A text whose UTF-8 bytes were read as Windows-1251, read again; one that isn't is left as it is."""

    @F.pandas_udf("string")
    def again(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else _again(t))

    return again(text)


def _again(text: str) -> str:
    try:
        return text.encode("cp1251").decode("utf-8")
    except UnicodeError:
        return text


def json_object(text: Column) -> Column:
    """The outermost {...} in a text as a variant; null where there is none or it is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), F.lit("")))


def cursor(at: Column, key: Column) -> Column:
    """The place of a row in a feed as text: time, bar, key."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("|"), key.cast("string"))


def cursor_parts(text: Column) -> Column:
    """struct<at, key> of a cursor; null where it is none."""
    at, key = F.substring_index(text, "|", 1), F.substring_index(text, "|", -1)
    return F.when(text.contains("|"), F.struct(at.try_cast("timestamp_ntz").alias("at"), key.alias("key")))


def safe_filename(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), "[^A-Za-z0-9._-]+", "_")
