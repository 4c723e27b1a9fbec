"""Encoded sizes of integers in tagged variable-length form, as expressions.

A number takes the fewest bytes whose bits, less the tag's, hold it: lengths 1
to 7 or else 9 for 64 bits (3 tag bits), 1 to 3 or else 5 for 32 bits (2 tag
bits). Signs and flags take one more bit each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: width -> (tag bits, lengths below the longest, the longest)
LENGTHS = {64: (3, range(1, 8), 9), 32: (2, range(1, 4), 5)}


def limits(width: int, extra_bits: int) -> list[tuple[int, int]]:
    """(first magnitude that no longer fits, bytes) from short to long."""
    tag, lengths, _ = LENGTHS[width]
    return [(1 << (8 * n - tag - extra_bits), n) for n in lengths]


def _size(magnitude: Column, width: int, extra_bits: int) -> Column:
    sizes = F.lit(LENGTHS[width][2])
    for limit, n in reversed(limits(width, extra_bits)):
        sizes = F.when(magnitude < F.lit(limit), F.lit(n)).otherwise(sizes)
    return sizes


def size_unsigned(value: Column, width: int) -> Column:
    """Bytes of a non-negative value; a negative one stands for its unsigned bit pattern, the longest; null for null."""
    return F.when(value < 0, F.lit(LENGTHS[width][2])).when(value.isNotNull(), _size(value, width, 0))


def size_signed(value: Column, width: int, flag: bool = False) -> Column:
    """Bytes of a signed value, with a flag bit if asked for; the least value has no magnitude and takes the longest; null for null."""
    least = -(1 << (width - 1))
    sizes = _size(F.abs(F.when(value == least, F.lit(0)).otherwise(value)), width, 1 + flag)
    return F.when(value == least, F.lit(LENGTHS[width][2])).when(value.isNotNull(), sizes)


def size_sql(column: str, width: int, signed: bool, flag: bool = False) -> str:
    """The same size as SQL text."""
    extra = (1 + flag) if signed else 0
    longest = LENGTHS[width][2]
    whens = " ".join(f"WHEN abs({column}) < {limit} THEN {n}" for limit, n in limits(width, extra))
    first = f"WHEN {column} = -{1 << (width - 1)} THEN {longest}" if signed else f"WHEN {column} < 0 THEN {longest}"
    return f"CASE {first} {whens} ELSE {longest} END"
