"""Deterministic opaque codes.

The reference draws random codes; random values change on task retry and the text file and the
reconciliation table must agree. Codes here are derived from SHA-256 of (run id, key): hex digits
are inside ``[A-Z0-9]``, and digits-only codes map hex letters a-f to 0-5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(run_id: str, key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(str(run_id)), F.lit("|"), k.cast("string")), 256)


def alnum_code(run_id: str, key, n: int) -> Column:
    """``n`` characters from ``[A-Z0-9]`` (upper-case hex), stable for (run id, key); ``n`` ≤ 64."""
    return F.upper(F.left(_digest(run_id, key), F.lit(n)))


def numeric_code(run_id: str, key, n: int) -> Column:
    """``n`` decimal digits, stable for (run id, key); ``n`` ≤ 64."""
    return F.translate(F.left(_digest(run_id, key), F.lit(n)), "abcdef", "012345")


def unique_key_30(run_id: str, customer) -> Column:
    """Reconciliation key: customer code + ``00`` + 20 alphanumerics (30 characters for an 8-char code)."""
    c = F.col(customer) if isinstance(customer, str) else customer
    return F.concat(c, F.lit("00"), alnum_code(run_id, c, 20))
