"""Text with units to numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per time unit and bytes per size unit.
SECONDS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
BYTES = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3, "tb": 1024**4}

_NUMBER = r"\A\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"


def _or_invalid(valid: Column, value: Column, text: Column, what: str, on_invalid: str) -> Column:
    if on_invalid not in ("raise", "null"):
        raise ValueError("on_invalid must be 'raise' or 'null'")
    chosen = F.when(valid & value.isNotNull(), value)  # null: too large for its type
    if on_invalid == "raise":
        message = F.concat(F.lit(f"not a {what}: "), text)
        chosen = chosen.when(text.isNotNull(), F.raise_error(message))
    return chosen


def _scaled(text: Column, units: dict, default: str) -> tuple[Column, Column]:
    shape = rf"(?i)\A\s*([0-9]+(?:\.[0-9]+)?)\s*({'|'.join(units)})?\s*\z"
    unit = F.lower(F.regexp_extract(text, shape, 2))
    factor = F.lit(float(units[default]))
    for name, size in units.items():
        factor = F.when(unit == name, F.lit(float(size))).otherwise(factor)
    return text.rlike(shape), F.regexp_extract(text, shape, 1).try_cast("double") * factor


def parse_duration(text: Column, on_invalid: str = "raise") -> Column:
    """Seconds as a double; a bare number counts seconds."""
    valid, value = _scaled(text, SECONDS, "s")
    return _or_invalid(valid, value, text, "duration", on_invalid)


def parse_byte_size(text: Column, on_invalid: str = "raise") -> Column:
    """Whole bytes; fractions are cut off."""
    valid, value = _scaled(text, BYTES, "b")
    return _or_invalid(valid, value.try_cast("bigint"), text, "byte size", on_invalid)


def parse_indexed_chars(text: Column, on_invalid: str = "raise") -> Column:
    """A whole number from float text such as ``100000.0`` or ``-1``."""
    valid = text.rlike(_NUMBER)
    value = F.trim(text).try_cast("double").try_cast("bigint")
    return _or_invalid(valid, value, text, "number of characters", on_invalid)
