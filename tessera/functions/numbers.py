"""Numeric expressions: money rounding, cents text, decimal commas, lenient integer parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import pad_left

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(38,2)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, scale: int) -> Column:
    """Banker's rounding (numpy semantics) on the decimal value."""
    return F.bround(_col(c), scale)


def round_2(c) -> Column:
    return round_half_even(c, 2)


def round_3(c) -> Column:
    return round_half_even(c, 3)


def amount_cents(c) -> Column:
    """Two-decimal amount as text without point or sign: ``-12.5`` → ``1250``, ``0.05`` → ``005``.

    Works on the decimal value (no binary-float formatting), then pads to at least three digits.
    """
    cents = (F.abs(F.bround(_col(c), 2)) * 100).cast("decimal(38,0)").cast("string")
    return pad_left(cents, "0", 3)


def comma_decimal(c) -> Column:
    """Decimal comma to point, then double; invalid text raises (ANSI cast), as the reference's astype does."""
    return F.replace(_col(c).cast("string"), F.lit(","), F.lit(".")).cast("double")


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_int_floor(c) -> Column:
    """Parse a decimal number and floor it to a nullable long; anything else (type suffixes, NaN, infinities,
    values a long cannot hold) is null."""
    text = _col(c).cast("string")
    value = F.floor(F.when(text.rlike(_NUMBER), text.try_cast("double")).otherwise(F.lit(None).cast("double")))
    return F.when(F.abs(text.try_cast("double")) < 9.2e18, value).cast("bigint")
