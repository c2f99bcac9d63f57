"""Raw extractor metadata to document fields, and their declared types.

The functions take a column as SQL text: 37 keys and 25 fields make one expression, parsed in
one go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsnap.schema import META_DATES, META_FIELDS, RAW_KEYS


def _field(metadata: str, field: str) -> str:
    keys = [key for key, target in RAW_KEYS.items() if target == field]
    values = [f"get(element_at({metadata}, '{key}'), 0)" for key in reversed(keys)]
    return values[0] if len(values) == 1 else f"coalesce({', '.join(values)})"


def meta_field(metadata: str, field: str) -> Column:
    """First value of the winning raw key; an empty list falls through to the next key."""
    return F.expr(_field(metadata, field))


def meta_struct(metadata: str = "metadata") -> Column:
    """All metadata fields, or null where not a single raw key has a value."""
    fields = ", ".join(f"'{name}', {_field(metadata, name)}" for name in META_FIELDS)
    known = ", ".join(f"'{key}'" for key in RAW_KEYS)
    return F.expr(
        f"if(exists(array({known}), k -> get(element_at({metadata}, k), 0) is not null), "
        f"named_struct({fields}), null)"
    )


# A year, optionally a month, a day, a time and a zone.
_DATE_SHAPE = (
    r"\A[0-9]{4}(-[0-9]{1,2}(-[0-9]{1,2}(T[0-9]{1,2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?)?"
    r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?)?)?\z"
)
# Filled up to a full date, time and zone, which the cast reads alike in every session.
_REPAIRS = (
    (r"\A([0-9]{4})\z", "$1-01"),
    (r"\A([0-9]{4}-[0-9]{1,2})\z", "$1-01"),
    (r"\A([^T]*)\z", "$1T00"),
    (r"(T[0-9]{1,2})(?=\z|Z|[+-])", "$1:00"),
    (r"(T[0-9]{1,2}:[0-9]{2})(?=\z|Z|[+-])", "$1:00"),
    (r"(T.*[+-][0-9]{2})([0-9]{2})\z", "$1:$2"),
    (r"(T.*[+-][0-9]{2})\z", "$1:00"),
    (r"(T[^Z+-]*)\z", "$1Z"),
    (",", "."),
)


def _date(text: str) -> str:
    whole = text
    for pattern, repaired in _REPAIRS:
        whole = f"regexp_replace({whole}, r'{pattern}', '{repaired}')"
    return f"if(rlike({text}, r'{_DATE_SHAPE}'), try_cast({whole} as timestamp), null)"


def typed_date(text: str) -> Column:
    """The timestamp a date field would be stored as; null for what it would reject."""
    return F.expr(_date(text))


def _short(text: str) -> str:
    number = f"nanvl(try_cast({text} as double), null)"
    return f"try_cast(if({number} >= 0, floor({number}), ceil({number})) as smallint)"


def typed_short(text: str) -> Column:
    """A short; a fraction is cut off, anything else out of range or not a number is null."""
    return F.expr(_short(text))


def _typed(name: str, value: str) -> str:
    if name in META_DATES:
        return _date(value)
    return _short(value) if name == "rating" else value


def typed_meta(meta: str = "meta") -> Column:
    """The metadata struct with dates as timestamps and the rating as a short."""
    fields = ", ".join(f"'{name}', {_typed(name, f'{meta}.{name}')}" for name in META_FIELDS)
    return F.expr(f"if({meta} is null, null, named_struct({fields}))")


def rejected_fields(meta: str = "meta") -> Column:
    """Names of the fields whose text does not fit the declared type."""
    checks = [
        f"if({meta}.{name} is not null and {_typed(name, f'{meta}.{name}')} is null, '{name}', null)"
        for name in (*META_DATES, "rating")
    ]
    return F.expr(f"array_compact(array({', '.join(checks)}))")
