"""Pseudorandom draws as functions of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drawn(*key: Column) -> Column:
    """32 pseudorandom bits that depend on the key alone: a counter-based draw, for which no order of drawing matters."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[k.cast("string") for k in key]).cast("binary")), 1, 8), 16, 10).cast("long")
