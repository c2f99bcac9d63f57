"""Text and content type of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsnap.schema import CONTENT_TYPE_KEY, DEFAULT_CONTENT_TYPE

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def content_text(parts: Column, indexed_chars: int = -1) -> Column:
    """Joined and stripped at both ends; cut to ``indexed_chars`` characters only if that is positive."""
    text = F.trim(F.coalesce(F.array_join(parts, "\n"), F.lit("")), F.lit(WHITE_SPACE))
    return F.substring(text, 1, indexed_chars) if indexed_chars > 0 else text


def indexed_chars_of(content: Column) -> Column:
    return F.coalesce(F.length(content), F.lit(0)).cast("bigint")


def content_type(metadata: Column, declared: Column | None = None) -> Column:
    """The declared type, else the extracted one, else the default, without parameters."""
    found = F.get(F.element_at(metadata, CONTENT_TYPE_KEY), F.lit(0))
    if declared is not None:
        found = F.coalesce(F.nullif(declared, F.lit("")), found)
    whole = F.coalesce(found, F.lit(DEFAULT_CONTENT_TYPE))
    return F.trim(F.substring_index(whole, ";", 1), F.lit(WHITE_SPACE))
