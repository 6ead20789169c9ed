"""Delimited-file scans: all-string reads, declared types, the long-row policy and null tokens.

Files are read by the ranged source of ``delimited``, in one scan: every file by its own header,
columns joined by name, fields with line breaks whole. No inference unless asked for
(``sink_schema_mode``). A row with more fields than its header is never cut: ``long_rows`` says
whether it raises, is dropped, or is kept apart (``scan_long_rows``, ``split_long_rows``). A shorter
row has nulls at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .delimited import FILE, LONG, scan_ranges, split_header
from .listing import first_lines

LATIN1 = "ISO-8859-1"

# Textual null tokens recognised by default (pandas' default NA strings).
DEFAULT_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                       "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

LONG_ROWS = ("raise", "drop", "quarantine")
_RAW = LONG
_NO_NULL = "\u0001"  # so that empty fields stay empty strings until null_tokens runs


def header_titles(lines: list[str], sep: str) -> list[str]:
    """All titles of some header lines, in the order they first stand in."""
    titles: dict[str, None] = {}
    for line in lines:
        own = split_header(line, sep)
        twice = sorted({t for t in own if own.count(t) > 1})
        if twice:
            raise ValueError(f"titles that stand twice in a header: {twice}")
        titles |= dict.fromkeys(own)
    return list(titles)


def headers_of(spark: SparkSession, path, encoding: str = LATIN1) -> list[str]:
    """The distinct header lines of the files, the most frequent first (file names stay in the tasks)."""
    heads = first_lines(spark, path, 1, encoding).where(F.size("lines") > 0).select(F.col("lines")[0].alias("line"))
    return [r["line"] for r in heads.groupBy("line").count().orderBy(F.desc("count"), "line").collect()]


def separators(line, sep: str):
    """Separators of a raw row that stand outside quotes."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep)


def is_long(titles: list[str], sep: str):
    """Condition on ``__raw_row`` (set for rows whose field count differs from the titles'): more fields than titles.

    Spark refuses a scan that reads nothing but the raw row (a plain count), so the first title is read too.
    """
    read = F.length(F.coalesce(F.col(f"`{titles[0]}`"), F.lit(""))) >= 0
    return F.col(_RAW).isNotNull() & (separators(F.col(_RAW), sep) >= len(titles)) & read


def apply_long_rows(df: DataFrame, titles: list[str], sep: str, long_rows: str) -> DataFrame:
    """Rows of a scan with ``__raw_row`` under the policy; the column is gone afterwards."""
    if long_rows not in LONG_ROWS:
        raise ValueError(f"long_rows is one of {LONG_ROWS}")
    long = is_long(titles, sep)
    if long_rows == "raise":
        error = F.raise_error(F.concat(F.lit("row with more fields than its header: "), F.col(_RAW))).cast("boolean")
        return df.where(F.when(long, error).otherwise(True)).drop(_RAW)
    return df.where(~long).drop(_RAW)


def null_tokens(df: DataFrame, tokens: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Textual null tokens (and empty strings) become null in every string column (or ``columns``)."""
    toks = DEFAULT_NULL_TOKENS if tokens is None else tokens
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(f"`{c}`").isin(*toks), F.lit(None).cast("string"))
                           .otherwise(F.col(f"`{c}`")) for c in cols})


def scan_csv_text(spark: SparkSession, path, sep: str = ";", encoding: str = LATIN1, tokens: list[str] | None = None,
                  long_rows: str = "raise", headers: list[str] | None = None, range_bytes: int | None = None) -> DataFrame:
    """Header row, every column a string, separator chosen by the caller, null tokens applied.

    Columns come in the order of the most frequent header; a column a file lacks is null there.
    ``headers`` are the files' header lines where the caller knows them; ``range_bytes`` is the
    length at which files are cut (the session's ``spark.sql.files.maxPartitionBytes``); tasks read
    many ranges of that length.
    """
    if long_rows not in LONG_ROWS:
        raise ValueError(f"long_rows is one of {LONG_ROWS}")
    titles = header_titles(headers_of(spark, path, encoding) if headers is None else headers, sep)
    if not titles:
        return spark.createDataFrame([], T.StructType([]))
    tokens = DEFAULT_NULL_TOKENS if tokens is None else tokens
    return scan_ranges(spark, path, titles, sep, encoding, tokens, "raise" if long_rows == "raise" else "drop", range_bytes=range_bytes)


def scan_long_rows(spark: SparkSession, path, sep: str = ";", encoding: str = LATIN1) -> DataFrame:
    """``(file_name, row)``: the raw rows that have more fields than their file's header (to count or to keep apart)."""
    titles = header_titles(headers_of(spark, path, encoding), sep)
    rows = scan_ranges(spark, path, titles, sep, encoding, [], "mark")
    return rows.where(F.col(LONG).isNotNull()).select(F.col(FILE).alias("file_name"), F.col(LONG).alias("row"))


def split_long_rows(spark: SparkSession, path, target: str, sep: str = ";", encoding: str = LATIN1,
                    tokens: list[str] | None = None) -> dict[str, int]:
    """Good and long rows written apart in one pass over the files; how many there were of each.

    ``target/rows=good`` has the scan's columns; ``target/rows=long`` the file name and the text of each
    row that has too many fields (``__file_name``, ``__raw_row``). The counts are observed by the write itself.
    """
    titles = header_titles(headers_of(spark, path, encoding), sep)
    rows = scan_ranges(spark, path, titles, sep, encoding, DEFAULT_NULL_TOKENS if tokens is None else tokens, "mark")
    seen = Observation()
    long = F.col(LONG).isNotNull()
    rows = rows.observe(seen, F.count_if(~long).alias("good"), F.count_if(long).alias("long"))
    rows.withColumn("rows", F.when(long, "long").otherwise("good")).write.mode("overwrite").partitionBy("rows").parquet(target)
    return {k: int(v) for k, v in seen.get.items()}


def scan_csv_bad_rows(spark: SparkSession, path, sep: str = ";", encoding: str = LATIN1,
                      tokens: list[str] | None = None) -> DataFrame:
    """All-string read that drops rows with too many fields and keeps short rows null-padded."""
    return scan_csv_text(spark, path, sep, encoding, tokens, long_rows="drop")


def scan_csv_typed(spark: SparkSession, path, types: dict[str, str], sep: str = ";", encoding: str = LATIN1,
                   long_rows: str = "drop", tokens: list[str] | None = None) -> DataFrame:
    """Read by header names, then cast the declared columns (strict cast: bad values raise);
    undeclared columns stay strings (identifiers keep their leading zeros)."""
    df = scan_csv_text(spark, path, sep, encoding, tokens, long_rows)
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in types.items() if c in df.columns})


def scan_csv_inferred(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Autodetected types (the warehouse's autodetect load mode)."""
    return spark.read.options(sep=sep, header="true", encoding=encoding, inferSchema="true").csv(path)
