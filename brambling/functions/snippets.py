"""A window of words around the first match, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, AFTER = 40, 39


def snippet(text: Column, terms: Column) -> Column:
    """The 40 words before the first word that contains a term, that word, and 39 after; without a match the first 40 words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    flags = F.transform(words, lambda w: F.exists(terms, lambda t: F.contains(F.lower(w), t)))
    place = F.array_position(flags, True).cast("int")
    start = F.greatest(F.lit(1), place - BEFORE)
    return F.array_join(F.when(place > 0, F.slice(words, start, place + AFTER - start + 1)).otherwise(F.slice(words, F.lit(1), F.lit(BEFORE))), " ")
