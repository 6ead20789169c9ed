"""Run status from a stream of run events: the last run of every pipeline, kept as keyed state.

The state is Structured Streaming's own: one row a key, the newest (time, tie) seen so far. An event
that comes late changes its key only when it is newer than what is held, so any order of arrival ends
in the same table as the batch query. Each micro-batch hands on the keys that changed, and these
replace theirs in a ``KeyedTable``; a micro-batch that is run again replaces its own versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.status import latest_run, status_rollup
from ..sinks.keyed import KeyedTable


def newest(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Of several rows of a key, the one of the newest run."""
    return latest_run(rows, keys, ts, tie, keep=(ts, tie))


def status_table(spark, path: str, keys: dict[str, str], ts: tuple[str, str] = ("ts", "timestamp_ntz"), tie: tuple[str, str] = ("run_id", "long"),
                 buckets: int = 16) -> KeyedTable:
    """The last run of each key: key columns with their types, status, time and tie."""
    names = list(keys)
    schema = ", ".join(f"{n} {t}" for n, t in [*keys.items(), ("status", "string"), ts, tie])
    return KeyedTable(spark, path, schema, names, lambda rows: newest(rows, names, ts[0], tie[0]), buckets)


def follow_status(events: DataFrame, table: KeyedTable, checkpoint: str, ts: str = "ts", tie: str = "run_id", forget_after: str | None = None) -> None:
    """Take every run event that is there into ``table`` and stop.

    ``events`` is a stream with the table's columns. State is kept for every key for good, unless
    ``forget_after`` (an interval) lets go of keys whose newest time is that far behind: then the time
    must be one of the keys, and later events of such keys are dropped.
    """
    if forget_after is not None:
        if ts not in table.keys:
            raise ValueError("only keys that hold the time can be forgotten")
        events = events.withWatermark(ts, forget_after)
    last = newest(events, table.keys, ts, tie)
    query = (last.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda batch, number: table.merge(number, batch) and None).start())
    query.awaitTermination()


def pipeline_status(table: KeyedTable, pipeline: str, group: list[str]) -> DataFrame:
    """Status of each pipeline, and of each group of pipelines (named ``GROUP``), as the table has them now."""
    last = table.read()
    each = last.select(*group, F.col(pipeline).cast("string").alias("name"), "status")
    return each.unionByName(status_rollup(last, group, out="status").select(*group, F.lit("GROUP").alias("name"), "status"))
