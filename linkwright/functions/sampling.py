"""Draws by hash, which any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drawn(key, seed: int = 42) -> Column:
    """A text by which to sort for a sample: md5 of the key and the seed."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def drawn_number(key, seed: int = 42) -> Column:
    """From 0 to 2^32 - 1, of the first eight digits."""
    return F.conv(F.substring(drawn(key, seed), 1, 8), 16, 10).cast("long")
