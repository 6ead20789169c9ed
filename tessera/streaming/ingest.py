"""Landing-folder ingest with Structured Streaming.

The reference polls a folder, loads each file and deletes it. Here the folder is a file stream
source: ``trigger(availableNow=True)`` processes every file present (in bounded micro-batches)
and stops; the checkpoint records which files were committed, so a rerun picks up only new
files and a failed run resumes without loading a file twice (exactly-once file pickup).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import qualified
from ..sources.csv import _RAW, LATIN1, apply_long_rows, null_tokens


def csv_stream(spark: SparkSession, folder: str, schema: T.StructType, sep: str = ";", encoding: str = LATIN1,
               pattern: str | None = None, max_files_per_trigger: int | None = None, long_rows: str = "raise") -> DataFrame:
    """Rows of the folder's files under the declared schema. A file whose header does not have the declared
    titles in their order raises; ``long_rows`` is the policy of the batch scans for rows with too many fields."""
    r = (spark.readStream.schema(T.StructType([*schema.fields, T.StructField(_RAW, T.StringType())])).option("sep", sep).option("header", "true").option("encoding", encoding)
         .option("nullValue", "\u0001").option("columnNameOfCorruptRecord", _RAW).option("columnPruning", "false")
         .option("escape", '"').option("enforceSchema", "false"))
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.csv(folder).withColumn("file_name", F.col("_metadata.file_name"))
    df = apply_long_rows(df, schema.names, sep, long_rows)
    return null_tokens(df, columns=[f.name for f in schema.fields if isinstance(f.dataType, T.StringType)])


def ingest_stream(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str,
                  transform: Callable[[DataFrame], DataFrame] | None = None, sep: str = ";",
                  encoding: str = LATIN1, pattern: str | None = None, fmt: str = "parquet", long_rows: str = "raise") -> dict:
    """Load every new file of ``folder`` into ``target`` (append) and stop; returns the last progress."""
    df = csv_stream(spark, folder, T.StructType(list(schema.fields)), sep, encoding, pattern, long_rows=long_rows)
    if transform is not None:
        df = transform(df)
    q = (df.writeStream.format(fmt).option("path", target).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    progress = q.lastProgress or {}
    return {"id": q.id, "numInputRows": progress.get("numInputRows", 0)}


def ingest_files(spark: SparkSession, folder: str, job: Callable[[SparkSession, list[str]], DataFrame], target: str,
                 checkpoint: str, pattern: str | None = None, max_files_per_trigger: int = 1000,
                 fmt: str = "parquet") -> None:
    """Run a file-level batch ``job(spark, paths) -> DataFrame`` over every new file of ``folder``.

    The folder is a streaming ``binaryFile`` listing (only the path column is read); each micro-batch
    holds at most ``max_files_per_trigger`` new files, whose paths are handed to the job (a bounded
    list of names, never file contents, passes through the driver). Each batch is written to
    ``target/source_id=<id>/batch_id=<id>`` with overwrite, so a replayed batch rewrites its own output:
    together with the checkpoint, every file is loaded exactly once. The source id is a digest of the checkpoint's
    place, so several ingests may share a target.
    """
    r = (spark.readStream.format("binaryFile")
         .schema("path string, modificationTime timestamp, length long, content binary")
         .option("maxFilesPerTrigger", max_files_per_trigger))
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    listing = r.load(folder).select("path")
    source_id = _source_id(checkpoint)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        paths = [row.path for row in batch.collect()]
        if paths:
            job(spark, paths).write.mode("overwrite").format(fmt).save(f"{target}/source_id={source_id}/batch_id={batch_id}")

    q = (listing.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


SOURCE, BATCH = "source_id", "batch_id"


def _source_id(checkpoint: str) -> str:
    return hashlib.sha256(qualified(checkpoint).rstrip("/").encode()).hexdigest()[:16]


def write_batch(rows: DataFrame, table: str, source: str, batch: int) -> None:
    """Make ``rows`` the rows of one source's batch in a catalog table, whatever a run before left there.

    The table is partitioned by source and batch (it is created so when it is not there), and the write
    overwrites that one partition, also with no rows at all.
    """
    spark = rows.sparkSession
    if not spark.catalog.tableExists(table):
        empty = rows.limit(0).withColumns({SOURCE: F.lit(source), BATCH: F.lit(batch).cast("long")})
        empty.write.format("parquet").partitionBy(SOURCE, BATCH).mode("ignore").saveAsTable(table)
    columns = spark.table(table).columns
    if columns[-2:] != [SOURCE, BATCH]:
        raise ValueError(f"{table} is not partitioned by {SOURCE} and {BATCH}")
    lacking = sorted(set(rows.columns) - set(columns))
    if lacking:
        raise ValueError(f"{table} has no columns {lacking}")
    view = f"batch_{source}_{batch}"
    rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).alias(c) for c in columns[:-2]]).createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({SOURCE} = '{source}', {BATCH} = {batch}) SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


def ingest_table(spark: SparkSession, folder: str, schema: T.StructType, table: str, checkpoint: str,
                 transform: Callable[[DataFrame], DataFrame] | None = None, sep: str = ";", encoding: str = LATIN1,
                 pattern: str | None = None, max_files_per_trigger: int | None = None, long_rows: str = "raise",
                 after_batch: Callable[[int], None] | None = None) -> None:
    """Load every new file of ``folder`` into a catalog table and stop; each file's rows stand there once.

    A batch that failed after its rows were written (or while they were) is run again by the next call
    and replaces them. Several sources may share a table. ``after_batch`` is called with the number of each written batch.
    """
    source = _source_id(checkpoint)
    df = csv_stream(spark, folder, T.StructType(list(schema.fields)), sep, encoding, pattern, max_files_per_trigger, long_rows)

    def load(rows: DataFrame, batch: int) -> None:
        write_batch(rows if transform is None else transform(rows), table, source, batch)
        if after_batch is not None:
            after_batch(batch)

    query = df.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
