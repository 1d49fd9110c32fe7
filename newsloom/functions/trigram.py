"""Trigram sets and their similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words of text, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, 3)))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both texts; 0 if neither has any, null for null."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_union(x, y))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(both == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)
