"""Gap-free sequence numbers in a total order without a single-task window.

Plan: a global sort (range partitioning from a sample of the sort keys, so a hot customer is
split across partitions by the tie-breaker), the position of each row inside its partition, a
written table in the shared checkpoint folder so both uses of the sorted rows see the same
partition assignment, per-partition counts (one row per partition), their prefix sums, and a
broadcast join of those offsets. The broadcast side has exactly one row per partition, so its size is bounded by the
partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOCAL_MASK = (1 << 33) - 1


def number_dense(df: DataFrame, order_cols: list, out: str = "nr", start: int = 1) -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order_cols`` order (dense, no gaps).

    ``order_cols`` must define a total order (add a tie-breaker) for the numbers to be stable.
    """
    ordered = (df.orderBy(*order_cols)
               .withColumn("__pid", F.spark_partition_id())
               .withColumn("__local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK))))
    ordered = materialize(ordered, "numbered")
    counts = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    numbered = ordered.join(F.broadcast(offsets), "__pid", "inner")
    return (numbered.withColumn(out, (F.col("__off") + F.col("__local") + F.lit(start)).cast("bigint"))
            .drop("__pid", "__local", "__off"))


def number_gapped(df: DataFrame, order_cols: list, keep, out: str = "nr", start: int = 1) -> DataFrame:
    """Number every row first, then keep the rows satisfying ``keep``: numbers have gaps, the count does not."""
    return number_dense(df, order_cols, out, start).where(keep)


def number_window_oracle(df: DataFrame, order_cols: list, out: str = "nr") -> DataFrame:
    """Single-window form (moves all rows to one task); used only as the test oracle."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order_cols)).cast("bigint"))
