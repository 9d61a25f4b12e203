"""Rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of its digits (2 ** 27 + 1).
SPLITTER = 134217729.0


def half_even(value: Column, digits: int) -> Column:
    """value rounded to so many digits, half to even, of what the double really is: 2.675 lies under the half and gives 2.67.

    The product with the power of ten is worked out with its rounding error, which decides where the product looks like a half. From 2 ** 52 on a double is whole and stays.
    """
    power = 10.0**digits
    size = F.abs(value)
    high = SPLITTER * size - (SPLITTER * size - size)
    product = size * power
    error = (high * power - product) + (size - high) * power
    whole = F.floor(product)
    over = product - whole
    up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    rounded = (whole + up.cast("int")) / power
    return F.when(product < 4503599627370496.0, F.when(value < 0, -rounded).otherwise(rounded)).otherwise(value)
