"""Registry of checked queries: key → (Spark callable, DuckDB oracle SQL or None).

``finalize`` fixes the presentation of results for the side-by-side check: decimals become
doubles, narrow integers become bigint (DuckDB's types for the same values), and dates and
timestamps become ISO text, which both engines render identically whatever a client library
does with date types. The oracle side gets the same presentation through ``typed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


MONEY_COLUMNS = ("SaldoCliente", "SaldoFornitura", "ImportoResiduoCompleto", "Avere", "Saldo", "total_amount",
                 "Amount", "detail_sum")


# Date and timestamp output columns of the checked queries (presented as ISO text on both sides).
SUPPLY_POINT_DATES = ("FINE_TIPO_POD", "DATA_INIZIO_FORNITURA", "DATA_FINE_FORNITURA", "DATA_DECORRENZA_RET",
                      "DATA_INIZIO_DISPACCIAMENTO", "DATA_MESSA_REGIME", "INST_MISURATOR_ATT", "INST_MISURATOR_REA",
                      "INST_MISURATOR_POT", "BF_DATA_INIZIO", "BF_DATA_FINE", "BF_DATA_RINNOVO", "BE_DATA_INIZIO",
                      "BE_DATA_FINE", "BE_DATA_CESSAZIONE", "DateUp")
TEXT_COLUMNS = {
    "apply_by_name_pattern": ("DATA_SPEDIZIONE", "INST_MISURATOR_ATT"),
    "date_range_files": ("day",),
    "drop_columns": ("o_orderdate",),
    "job_pipeline_status": ("day",),
    "job_price_import": ("Data", "DateUp"),
    "job_registry_import": ("DateUp",),
    "job_supply_point_import": SUPPLY_POINT_DATES,
    "max_date": ("max_date",),
    "parse_compact_date": ("d",),
    "parse_dayfirst": ("d",),
    "project_fixed": ("l_shipdate",),
    "rename_positional": ("l_shipdate",),
    "scan_csv_typed": ("o_orderdate",),
    "sink_schema_mode": ("o_orderdate",),
    "status_rollup": ("day",),
    "with_load_time": ("DateUp",),
}


# Integer columns that hold nulls: client libraries disagree on their pandas type (float64/NaN vs
# Int64/<NA>), so both sides present them as DOUBLE (exact for these values).
NULLABLE_INT_COLUMNS = {
    "apply_by_name_pattern": ("K_TRASFOR_ATT",),
    "job_supply_point_import": ("K_TRASFOR_ATT", "K_TRASFOR_REA", "K_TRASFOR_POT", "NUM_CIFRE_EA", "NUM_CIFRE_ER",
                                "NUM_CIFRE_ATT", "NUM_CIFRE_REA", "NUM_CIFRE_POT"),
    "to_int_floor": ("k", "value_floor", "kind_num"),
}


def typed(sql: str, double: tuple = (), bigint: tuple = (), text: tuple = ()) -> str:
    """Wrap oracle SQL so the named columns come out as DOUBLE / BIGINT / VARCHAR (Spark's finalized types)."""
    reps = ([f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in double] + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in bigint]
            + [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in text])
    if not reps:
        return sql
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{sql}\n) AS _q"


def register(key: str, sql: str | None = None, double: tuple = (), bigint: tuple = ()):
    as_double = NULLABLE_INT_COLUMNS.get(key, ())
    if sql is not None:
        sql = typed(sql, tuple(double) + as_double, bigint, TEXT_COLUMNS.get(key, ()))

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = finalize(fn(spark, sf_dir))
            return df.withColumns({c: F.col(c).cast("double") for c in as_double}) if as_double else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_ledger, q_functions, q_sources, q_sinks, q_misc  # noqa: F401
