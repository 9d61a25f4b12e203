"""Likeness of two fingerprints: a 64-bit hash (two halves of 32 bits, as longs) and a colour histogram."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_even


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def shape(distance: Column) -> Column:
    """0 for unrelated hashes (half of the bits differ), 1 for equal ones."""
    return F.greatest(F.lit(0.0), (1 - distance / 64 - 0.5) * 2)


def color(a: Column, b: Column) -> Column:
    """Histogram intersection, summed in order of bins."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, v: s + v)


def overall(distance: Column, colors: Column) -> Column:
    return F.lit(0.55) * shape(distance) + F.lit(0.45) * colors


def encoded(hi: Column, lo: Column, histogram: Column) -> Column:
    """A fingerprint as it is stored: 16 hex digits, and the histogram to five digits (half to even)."""
    digits = lambda half: F.lpad(F.lower(F.hex(half)), 8, "0")
    return F.struct(F.concat(digits(hi), digits(lo)).alias("phash"), F.transform(histogram, lambda v: half_even(v, 5)).alias("histogram"))


def decoded(stored: Column) -> tuple[Column, Column, Column]:
    """Both halves of the hash, and the histogram, of a stored fingerprint."""
    half = lambda at: F.conv(F.substring(stored["phash"], at, 8), 16, 10).cast("long")
    return half(1), half(9), stored["histogram"]


def hash_bits(values: Column, first: int, n: int = 32) -> Column:
    """Bits first..first+n-1 of `value > median of all values but the first`, most significant bit first, as a long."""
    return F.aggregate(F.slice(values, first + 1, n), F.lit(0).cast("long"), lambda h, v: h * 2 + v.cast("long"))
