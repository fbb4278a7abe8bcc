"""Column functions for sizes, bands and content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.rules import BAND_LIMITS, TOP_BAND


def complexity_band(complexity: Column) -> Column:
    band = F.lit(TOP_BAND)
    for name, limit in reversed(BAND_LIMITS):
        band = F.when(complexity <= limit, name).otherwise(band)
    return band


def size_kb(size: Column) -> Column:
    return F.round(size / 1024, 1)


def utf16_length(content: Column) -> Column:
    """Length in UTF-16 units, as JavaScript counts."""
    return (F.octet_length(F.encode(content, "UTF-16BE")) / 2).cast("bigint")


def content_key(content: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the text."""
    return F.left(F.sha2(content, 256), F.lit(32))
