"""Word cutting shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a word is a run of characters outside this set
SPACES = r"[\x20\x09-\x0D]+"


def filled(text: Column) -> Column:
    """Null text counts as the empty text."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, unchanged, in order; none for null or blank text."""
    return F.array_remove(F.split(filled(text), SPACES), "")
