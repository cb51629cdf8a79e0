"""Predicates and projections of evidence: intervals, years, coverage, reason codes, status, highlights, offsets."""

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(low: Column, high: Column, least: float, most: float) -> Column:
    """Whether the interval [low, high] meets [least, most]."""
    return (low <= most) & (high >= least)


def within_years(at: Column, years: int, now: int) -> Column:
    """Whether a time lies in the window of so many years that ends with year `now`, a parameter so that reruns agree."""
    return F.year(at).between(now - years, now)


def named_like(name: Column, part: str) -> Column:
    return F.lower(name).contains(part.lower())


def demoted(status: Column, confidence: Column, threshold: float) -> Column:
    """Confirmed artifacts below the larger of threshold and 0.72 become candidates."""
    return F.when((status == "confirmed") & (confidence < max(0.72, threshold)), "candidate").otherwise(status)


def claim_status(status: Column, confidence: Column) -> Column:
    """confirmed: verified from 0.9 on, else auto_verified; disputed: conflicting; all others: candidate."""
    confirmed = F.when(confidence >= 0.9, "verified").otherwise("auto_verified")
    return F.when(status == "confirmed", confirmed).when(status == "disputed", "conflicting").otherwise("candidate")


def highlighted(text: Column, start: Column, mark_from: Column, mark_to: Column) -> Column:
    """The part of a span's text between two offsets of its document; the span begins at start."""
    first = F.greatest(F.lit(0), mark_from - start)
    return F.substring(text, first + 1, F.greatest(F.lit(0), mark_to - start - first))


def running_start(text: Column, document: str, *order: str) -> Column:
    """Where a span begins in its document's text, spans in order being joined by two line ends."""
    length = F.length(F.coalesce(text, F.lit(""))) + 2
    return F.sum(length).over(W.partitionBy(document).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - length
