"""Table and CSV sinks: append, overwrite, create-only, chunked files, load metrics.

A target is a path (a table of Parquet files in shared storage) or, with ``as_table=True``, a
catalog table name. Appends never de-duplicate: loading the same input twice doubles the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOAD_CHUNK_ROWS = 100_000


def _writer(df: DataFrame, mode: str, fmt: str = "parquet", max_records: int | None = None):
    w = df.write.mode(mode).format(fmt)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    return w


def _save(w, target: str, as_table: bool) -> None:
    if as_table:
        w.saveAsTable(target)
    else:
        w.save(target)


def _target_columns(spark: SparkSession, target: str, as_table: bool, fmt: str) -> list[str] | None:
    try:
        t = spark.table(target) if as_table else spark.read.format(fmt).load(target)
        return t.columns
    except Exception:  # noqa: BLE001 - target does not exist yet
        return None


def sink_append(df: DataFrame, target: str, as_table: bool = False, fmt: str = "parquet",
                by_position: bool = False) -> None:
    """Append rows. ``by_position`` maps columns to the existing target's columns by position (a
    headerless file loaded into a table); otherwise columns are matched by name."""
    if by_position:
        cols = _target_columns(df.sparkSession, target, as_table, fmt)
        if cols is not None:
            if len(cols) != len(df.columns):
                raise ValueError(f"{len(df.columns)} columns for a target with {len(cols)}")
            df = df.toDF(*cols)
        if as_table and cols is not None:
            df.write.insertInto(target)
            return
    _save(_writer(df, "append", fmt), target, as_table)


def sink_overwrite(df: DataFrame, target: str, as_table: bool = False, fmt: str = "parquet") -> None:
    _save(_writer(df, "overwrite", fmt), target, as_table)


def sink_create_only(df: DataFrame, target: str, as_table: bool = False, fmt: str = "parquet",
                     chunk_rows: int | None = LOAD_CHUNK_ROWS) -> tuple[bool, str]:
    """Create the target; fail if it exists. The outcome is returned as a value, not raised."""
    try:
        _save(_writer(df, "errorifexists", fmt, chunk_rows), target, as_table)
        return True, "Caricamento riuscito"
    except Exception as e:  # noqa: BLE001 - the error message is the result
        return False, f"Errore: {str(e).splitlines()[0][:300]}"


def sink_chunked(df: DataFrame, target: str, chunk_rows: int = LOAD_CHUNK_ROWS, mode: str = "overwrite",
                 fmt: str = "parquet") -> None:
    """Write with at most ``chunk_rows`` rows per file (files, not a driver-side loop, are the chunks)."""
    _writer(df, mode, fmt, chunk_rows).save(target)


def sink_csv(df: DataFrame, target: str, sep: str = ";", header: bool = True, encoding: str = "UTF-8",
             mode: str = "overwrite") -> None:
    """Delimited text: separator, header on/off (prices are written without header), encoding. Quotes inside a value are doubled."""
    (df.write.mode(mode).option("sep", sep).option("header", str(header).lower()).option("encoding", encoding)
     .option("emptyValue", "").option("escape", '"').csv(target))


def load_with_metrics(spark: SparkSession, df: DataFrame, target: str, mode: str = "append",
                      fmt: str = "parquet", as_table: bool = False) -> DataFrame:
    """Write ``df`` and return one row: rows loaded by this write and total rows in the target after it.

    The loaded count is observed during the write itself (no second pass over the input).
    """
    obs = Observation("load")
    _save(_writer(df.observe(obs, F.count(F.lit(1)).alias("rows_loaded")), mode, fmt), target, as_table)
    loaded = obs.get["rows_loaded"]
    total = spark.table(target) if as_table else spark.read.format(fmt).load(target)
    return total.agg(F.lit(loaded).cast("bigint").alias("rows_loaded"), F.count(F.lit(1)).alias("total_rows"))
