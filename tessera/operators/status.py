"""Run-status roll-up, latest run per key, date-range validation and export-name rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Run statuses and the group outcome labels.
COMPLETED, RUNNING, REJECTED = "COMPLETED", "RUNNING", "REJECTED"
GROUP_RUNNING = "In esecuzione"
GROUP_STARTING = "In avvio"
GROUP_REJECTED = "Rigettato"


def latest_run(runs: DataFrame, key, ts: str, tie: str, status: str = "status", keep: tuple = ()) -> DataFrame:
    """Status of the newest run per key (ties on ``ts`` broken by the larger ``tie``), and its ``keep`` columns.

    ``max_by`` over a struct is a plain hash aggregate with partial aggregation, so a key with
    a third of all runs is reduced map-side before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    newest = F.max_by(F.struct(status, *keep), F.struct(F.col(ts), F.col(tie))).alias("__run")
    return runs.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"__run.{c}").alias(c) for c in (status, *keep)])


def status_rollup(statuses: DataFrame, group_cols: list[str], status: str = "status",
                  out: str = "group_status") -> DataFrame:
    """Any COMPLETED and no REJECTED → running; else any RUNNING → starting; else rejected."""
    s = F.col(status)
    agg = statuses.groupBy(*group_cols).agg(
        F.bool_or(s == COMPLETED).alias("__c"), F.bool_or(s == REJECTED).alias("__r"),
        F.bool_or(s == RUNNING).alias("__u"))
    label = (F.when(F.col("__c") & ~F.col("__r"), GROUP_RUNNING)
             .when(F.col("__u"), GROUP_STARTING).otherwise(GROUP_REJECTED))
    return agg.select(*group_cols, label.alias(out))


def validate_range(start: Column, end: Column) -> tuple[Column, Column]:
    """(accepted, reason): both dates present and end ≥ start."""
    missing = start.isNull() | end.isNull()
    reason = (F.when(missing, F.lit("inserire data d'inizio e di fine"))
              .when(end < start, F.lit("la data di inizio deve essere precedente alla data di fine")))
    return reason.isNull(), reason


def share_name(name: Column) -> tuple[Column, Column]:
    """Export file name: blanks removed; ends with ``.csv`` → kept; no dot → ``.csv`` added; else rejected.

    Returns (file_name or null, accepted flag).
    """
    n = F.regexp_replace(name, " ", "")
    parts = F.split(n, r"\.", -1)
    last = F.element_at(parts, -1)
    ok_csv = last == "csv"
    no_dot = F.size(parts) < 2
    file_name = F.when(ok_csv, n).when(no_dot, F.concat(n, F.lit(".csv")))
    return file_name, file_name.isNotNull()
