"""Column-name transforms (metadata only: they compile to a projection with aliases)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header clean-up replacements, applied in this order (space → underscore last).
HEADER_REPLACEMENTS = [
    (".", ""), ("?", ""), ("(", ""), ("/", ""), (")", ""), ("à", ""), ("è", ""), ("é", ""), ("ù", ""),
    ("[", ""), ("]", ""), ("+", ""), ("#", ""), ("°", ""), ("ò", ""), ("\\", ""), ('"', ""), ("'", ""),
    ("\xc3\xaf\xc2\xbf\xc2\xbd", ""), (" ", "_"),
]

TREATMENT_NAMES = ("Trattamento_m1", "Trattamento_m")
BANDS = ("F1", "F2", "F3")


def _project(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(df.columns, names)])


def sanitise_name(name: str) -> str:
    for old, new in HEADER_REPLACEMENTS:
        name = name.replace(old, new)
    return name


def sanitise_headers(df: DataFrame) -> DataFrame:
    """Clean every header; upper-case accents stay and clashes are not resolved (as the reference)."""
    return _project(df, [sanitise_name(c) for c in df.columns])


def rename_positional(df: DataFrame, positions: dict[int, str] | None = None) -> DataFrame:
    """Rename columns by 0-based position (default: 4 and 5 → the two treatment columns)."""
    positions = positions or {4: TREATMENT_NAMES[0], 5: TREATMENT_NAMES[1]}
    names = list(df.columns)
    for i, n in positions.items():
        names[i] = n
    return _project(df, names)


def band_month_name(title: str) -> str:
    """``…F1…06`` → ``F1_06`` when the title holds a band and not ``CONSUMO``; else unchanged."""
    if "CONSUMO" in title:
        return title
    for band in BANDS:
        if band in title:
            return f"{band}_{title[-2:]}"
    return title


def rename_pattern(df: DataFrame) -> DataFrame:
    return _project(df, [band_month_name(c) for c in df.columns])


def project_fixed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Select and reorder to a declared list; a missing column raises (analysis error)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def excel_columns(spec: str) -> tuple[int, int]:
    """``'A:AA'`` → (0, 27): the half-open positional range of a sheet column spec."""
    def idx(s: str) -> int:
        n = 0
        for ch in s.strip().upper():
            n = n * 26 + (ord(ch) - 64)
        return n
    a, b = spec.split(":")
    return idx(a) - 1, idx(b)


def sheet_columns(df: DataFrame, spec: str) -> DataFrame:
    """Positional column range of a sheet that arrived as a table (``usecols='A:AA'``)."""
    lo, hi = excel_columns(spec)
    return df.select(*[F.col(f"`{c}`") for c in df.columns[lo:hi]])
