"""Keyed randomness: the same key gives the same number on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


WORDS = 4


def digest(*parts: Column | str | int) -> Column:
    """The md5 of the parts joined by ':', as 32 hexadecimal digits."""
    columns = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def word(hexadecimal: Column, i: int | Column = 0) -> Column:
    """Word ``i`` of a digest's four: an integer in [0, 2^32)."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(hexadecimal, (i * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("bigint")


def hash32(*parts: Column | str | int) -> Column:
    """Integer in [0, 2^32) from the md5 of the parts joined by ':'."""
    return word(digest(*parts))


def hash01(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1)."""
    return hash32(*parts) / F.lit(float(SPAN))
