"""Checksums and document ids."""

from __future__ import annotations

import hashlib
import logging

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)


def _python_digest(algorithm: str):
    @F.pandas_udf("string")
    def digest(data: pd.Series) -> pd.Series:
        return data.map(
            lambda raw: hashlib.new(algorithm, raw).hexdigest(), na_action="ignore"
        )

    return digest


def checksum(data: Column, algorithm: str | None) -> Column:
    """Hex digest of the bytes; null without an algorithm or with an unknown one."""
    if not algorithm:
        return F.lit(None).cast("string")
    name = algorithm.lower().replace("-", "")
    if name == "md5":
        return F.md5(data)
    if name == "sha1":
        return F.sha1(data)
    if name in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(data, int(name[3:]))
    try:
        hashlib.new(name, b"").hexdigest()
    except (ValueError, TypeError):
        logger.warning("unknown checksum algorithm: %s", algorithm)
        return F.lit(None).cast("string")
    return _python_digest(name)(data)


def content_hash(data: Column, algorithm: str | None) -> Column:
    """The configured checksum, or SHA-256 where that gives nothing."""
    return F.coalesce(checksum(data, algorithm), F.sha2(data, 256))


def path_id(path: Column, id_mode: str) -> Column:
    return F.sha2(path, 256) if id_mode == "path_hash" else path
