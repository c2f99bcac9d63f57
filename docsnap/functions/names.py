"""File names: last part, extension, glob patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-cased suffix without its dot; empty for ``.hidden`` and for ``ends.``."""
    return F.lower(F.regexp_extract(name, r"(?s)\A.+\.([^.]+)\z", 1))


def _quoted(char: str) -> str:
    return char if char.isalnum() or not char.isascii() else "\\" + char


def _char_class(body: str) -> str:
    negated, members, i = body.startswith("!"), [], 0
    body = body[1:] if negated else body
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            if body[i] <= body[i + 2]:
                members.append(f"{_quoted(body[i])}-{_quoted(body[i + 2])}")
            i += 3
        else:
            members.append(_quoted(body[i]))
            i += 1
    if not members:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(members)}]"


def glob_regex(pattern: str) -> str:
    """A Java regex for a shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``), unanchored."""
    parts, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        i += 1
        if char == "*":
            if parts[-1:] != [".*"]:
                parts.append(".*")
        elif char == "?":
            parts.append(".")
        elif char == "[":
            # A bracket right after the opening (or after its "!") belongs to the set.
            first = i + 1 if pattern[i : i + 1] == "!" else i
            end = pattern.find("]", first + 1)
            if end < 0:
                parts.append(r"\[")
            else:
                parts.append(_char_class(pattern[i:end]))
                i = end + 1
        else:
            parts.append(_quoted(char))
    return "".join(parts)


def matches_any(name: Column, patterns: Sequence[str]) -> Column:
    """One anchored alternation for the whole pattern list, so each name is tested once."""
    union = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return name.rlike(rf"(?s)\A(?:{union})\z")


def passes_patterns(
    name: Column, includes: Sequence[str] = (), excludes: Sequence[str] = ()
) -> Column:
    """Included by at least one pattern (where any is given) and excluded by none."""
    keep = matches_any(name, includes) if includes else F.lit(True)
    return keep & ~matches_any(name, excludes) if excludes else keep
