"""A keyed table that is updated batch by batch, writing what a batch brings and seldom more.

Rows live in hash buckets of their first key. Every batch writes its own rows, combined to one a key,
under its own number, and then a list of the buckets it touched. The list commits the batch: readers
combine the listed versions of each bucket, so they see a batch whole or not at all, and a batch that is
run again replaces its own versions. A batch that touches a bucket of many versions writes it whole,
from the state before it, and readers need no older version of that bucket: so a table of n keys that
gets m rows writes about m rows, and n more once in ``versions`` batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, qualified


class KeyedTable:
    """Rows of ``schema`` under ``path`` (shared storage), one a value of ``keys``.

    ``combine`` takes rows of the schema, several of a key among them, to one a key. It must be
    associative, as it is applied to combined rows again. ``versions`` is the number of versions of
    a bucket that readers combine at most.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], combine: Callable[[DataFrame], DataFrame], buckets: int = 64, versions: int = 8):
        self.spark, self.path, self.keys, self.combine, self.buckets, self.versions = spark, path.rstrip("/"), keys, combine, buckets, versions
        self.schema = spark.createDataFrame([], schema).schema

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(qualified(path))
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p))

    def _current(self, before: int | None) -> DataFrame | None:
        """(bucket, batch) of the committed versions that make up the state, of batches below ``before``: those since a bucket was written whole."""
        if not self._exists(f"{self.path}/commits"):
            return None
        commits = self.spark.read.schema("bucket int, whole boolean, batch long").parquet(f"{self.path}/commits")
        if before is not None:
            commits = commits.where(F.col("batch") < before)
        whole = F.coalesce("whole", F.lit(True))  # a list without the mark is of versions that were all whole
        since = commits.groupBy("bucket").agg(F.max(F.when(whole, F.col("batch"))).alias("since"))  # at most one row a bucket
        return commits.join(F.broadcast(since), "bucket").where(F.col("since").isNull() | (F.col("batch") >= F.col("since"))).select("bucket", "batch")

    def _rows(self, current: DataFrame) -> DataFrame:
        """The rows of some versions, a key's rows of several batches apart."""
        rows = self.spark.read.schema(f"{self.schema.toDDL()}, bucket int, batch long").parquet(f"{self.path}/rows")
        return rows.join(F.broadcast(current), ["batch", "bucket"], "left_semi").select(*self.schema.names)

    def read(self, before: int | None = None, combined: bool = True) -> DataFrame:
        """The table's rows after all batches, or those below ``before``.

        Without ``combined``, a key may have a row of each of several batches: for roll-ups that
        combine rows themselves, which then need no pass by key before.
        """
        current = self._current(before)
        if current is None:
            return self.spark.createDataFrame([], self.schema)
        rows = self._rows(current)
        return self.combine(rows).select(*self.schema.names) if combined else rows

    def _full(self, batch: int) -> DataFrame | None:
        """Buckets that have as many versions before ``batch`` as readers may combine."""
        current = self._current(batch)
        if current is None:
            return None
        full = current.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.versions).select("bucket")
        return None if full.isEmpty() else full

    def merge(self, batch: int, delta: DataFrame) -> int:
        """Combine ``delta`` into the table as batch ``batch``; the number of buckets it touched."""
        names = self.schema.names
        bucket = F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")
        rows = self.combine(delta.select(*names)).select(*names)
        grown = None
        if (full := self._full(batch)) is not None:
            rows = materialize(rows.withColumn("bucket", bucket), "keyed-delta")
            grown = materialize(rows.select("bucket").distinct().join(full, "bucket", "left_semi"), "keyed-grown")
            state = self._rows(self._current(batch).join(grown, "bucket", "left_semi"))
            add = rows.join(F.broadcast(grown), "bucket", "left_semi").select(*names)
            rows = rows.join(F.broadcast(grown), "bucket", "left_anti").select(*names).unionByName(self.combine(state.unionByName(add)).select(*names))
        rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={batch}")
        written = self.spark.read.schema(f"{self.schema.toDDL()}, bucket int").parquet(f"{self.path}/rows/batch={batch}")
        touched = written.select("bucket").distinct()
        marked = touched.withColumn("whole", F.lit(False)) if grown is None else touched.join(grown.withColumn("grown", F.lit(True)), "bucket", "left").select("bucket", F.col("grown").isNotNull().alias("whole"))
        marked.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return self.spark.read.schema("bucket int, whole boolean").parquet(f"{self.path}/commits/batch={batch}").count()
