"""File listings as DataFrames: routing by name, periods from names, day-range selection.

A listing is a DataFrame of file names (from ``binaryFile``/``_metadata`` or any table), so the
classification and selection rules are column expressions that run where the listing lives.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..functions.dates import filename_period_fixed

# Name markers that route dropped files to a job.
GAS_MARK = "gas"
SUPPLY_POINT_MARK = "REP_ELE"
FLOW15_MARK, CSV_MARK = "15", ".csv"
ARCHIVE_MARKS = (".zip", ".ZIP")
PRICE_SUFFIX = "MGPPrezzi.xml"


def route(name) -> Column:
    """Job for a dropped file: archive, supply_points, flow15, gas_library or electricity_library."""
    n = F.col(name) if isinstance(name, str) else name
    return (F.when(n.contains(ARCHIVE_MARKS[0]) | n.contains(ARCHIVE_MARKS[1]), "archive")
            .when(n.contains(SUPPLY_POINT_MARK), "supply_points")
            .when(n.contains(FLOW15_MARK) & n.contains(CSV_MARK), "flow15")
            .when(n.contains(GAS_MARK), "gas_library")
            .otherwise("electricity_library"))


def list_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Names (and sizes) of the files in a folder, read as metadata only (no content columns selected)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
          .load(folder))
    return df.select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length"))


def first_lines(spark: SparkSession, path, lines: int = 1, encoding: str = "ISO-8859-1") -> DataFrame:
    """``(path, name, lines array<string>)``: the first lines of every file, read by tasks that open no more of it."""
    ship_package(spark)
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def read(batches):
        import io

        import pandas as pd

        from tessera.sources.ranges import open_data
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                with open_data(p) as f:
                    text = io.TextIOWrapper(io.BufferedReader(f, 1 << 16), encoding=encoding, newline="")
                    rows.append((p, p.rsplit("/", 1)[-1], [line.rstrip("\r\n") for line in itertools.islice(text, lines)]))
            yield pd.DataFrame(rows, columns=["path", "name", "lines"])

    return paths.mapInPandas(read, "path string, name string, lines array<string>")


def period_of_batch(listing: DataFrame, name: str = "name") -> DataFrame:
    """(Anno, Mese) of a supply-point batch: the last matching name (by name order) wins; (0, 0) if none."""
    hits = listing.where(F.col(name).contains(SUPPLY_POINT_MARK))
    last = hits.agg(F.max(name).alias("__last"))
    y, m = filename_period_fixed(F.col("__last"))
    return last.select(F.coalesce(y, F.lit(0)).alias("Anno"), F.coalesce(m, F.lit(0)).alias("Mese"))


def day_names(spark: SparkSession, start: str, end: str, suffix: str = PRICE_SUFFIX) -> DataFrame:
    """Inclusive day list ``start``..``end`` (yyyy-MM-dd) as ``yyyyMMdd`` + suffix, with the day."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)),
                                                       F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.select("day", F.concat(F.date_format("day", "yyyyMMdd"), F.lit(suffix)).alias("name"))


def date_range_files(spark: SparkSession, start: str, end: str, listing: DataFrame, name: str = "name",
                     suffix: str = PRICE_SUFFIX) -> DataFrame:
    """Generated day names kept only when present in the listing (left semi join), in day order."""
    wanted = day_names(spark, start, end, suffix)
    return wanted.join(listing.select(F.col(name).alias("__n")), wanted.name == F.col("__n"), "left_semi").orderBy("day")
