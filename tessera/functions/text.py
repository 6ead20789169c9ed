"""Text expressions: padding without truncation, blanks, name folding, id helpers.

All functions take and return ``Column`` objects so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented capitals folded to letter + apostrophe, in the order applied.
# (É is deliberately not folded.)
NAME_FOLDS = [("Ù", "U'"), ("Ò", "O'"), ("Ì", "I'"), ("È", "E'"), ("À", "A'")]
NAME_MAX = 90


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_left(s, fill: str, n: int) -> Column:
    """Left-pad ``s`` with ``fill`` to ``n`` characters; longer input is kept whole (no truncation)."""
    s = _col(s)
    return F.when(F.length(s) < n, F.lpad(s, n, fill)).otherwise(s)


def pad_right(s, fill: str, n: int) -> Column:
    """Right-pad ``s`` with ``fill`` to ``n`` characters; longer input is kept whole."""
    s = _col(s)
    return F.when(F.length(s) < n, F.rpad(s, n, fill)).otherwise(s)


def spaces(n: int) -> Column:
    """``n`` blanks as a constant column (folded at planning time)."""
    return F.lit(" " * n)


def truncate_id(s, n: int = 14) -> Column:
    """Cut an identifier (POD) to its first ``n`` characters; null stays null."""
    return F.substring(_col(s), 1, n)


def pad_id(s, n: int = 14) -> Column:
    """Left-zero-pad an identifier to ``n`` characters without truncation; null stays null."""
    return pad_left(_col(s).cast("string"), "0", n)


def fold_name(full_name, name=None) -> Column:
    """``LEFT(UPPER(COALESCE(full_name, name)), 90)`` then the five accent folds (result may exceed 90)."""
    base = _col(full_name) if name is None else F.coalesce(_col(full_name), _col(name))
    out = F.left(F.upper(base), F.lit(NAME_MAX))
    for src, dst in NAME_FOLDS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def coalesce_id(fiscal_code, vat_no) -> Column:
    """Fiscal code, else VAT number; an empty string is a value, not a null."""
    return F.coalesce(_col(fiscal_code), _col(vat_no))


def upper_code(s) -> Column:
    return F.upper(_col(s))


def letter_o_to_zero(s) -> Column:
    """If a lower-case ``o`` is present replace every ``o`` by ``0``; else replace ``O`` by ``0``; null stays null."""
    s = _col(s)
    return (F.when(s.contains("o"), F.replace(s, F.lit("o"), F.lit("0")))
            .when(s.contains("O"), F.replace(s, F.lit("O"), F.lit("0")))
            .otherwise(s))


def not_like_any(s, *needles: str) -> Column:
    """``NOT (s LIKE '%a%' OR s LIKE '%b%')`` with SQL three-valued logic (null input gives null)."""
    s = _col(s)
    cond = None
    for n in needles:
        c = s.contains(n)
        cond = c if cond is None else (cond | c)
    return ~cond
