"""Word-level text functions on JVM built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_words(text: Column) -> Column:
    """Lower-cased words without punctuation (category P), parted at white space."""
    bare = F.regexp_replace(F.lower(text), r"\p{P}+", "")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")

