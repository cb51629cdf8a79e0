"""Identity of spans, entities and points, as Column expressions that are the same on every retry."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_id(document: Column, page: Column, start: Column, end: Column, table: Column | None = None) -> Column:
    parts = [c.cast("string") for c in (document, page, start, end)] + [F.coalesce(table, F.lit("")) if table is not None else F.lit("")]
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 16)


def entity_id(kind: Column, name: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", kind, F.lower(F.trim(name)))), 1, 16)


def point_id(span: Column) -> Column:
    return F.regexp_replace(F.substring(F.sha2(span, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
