"""Terms of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
