"""Sinks (append/overwrite/create-only/chunked/metrics) and exactly-once streaming ingest."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sinks import tables as SK
from tessera.sources import csv as CSV
from tessera.streaming.ingest import ingest_stream


def test_append_doubles_overwrite_replaces(spark, tmp_dir):
    df = spark.range(10)
    SK.sink_append(df, f"{tmp_dir}/a")
    SK.sink_append(df, f"{tmp_dir}/a")
    assert spark.read.parquet(f"{tmp_dir}/a").count() == 20
    SK.sink_overwrite(df, f"{tmp_dir}/a")
    assert spark.read.parquet(f"{tmp_dir}/a").count() == 10


def test_create_only_returns_error_value(spark, tmp_dir):
    df = spark.range(3)
    assert SK.sink_create_only(df, f"{tmp_dir}/c")[0] is True
    ok, msg = SK.sink_create_only(df, f"{tmp_dir}/c")
    assert ok is False and msg.startswith("Errore")
    assert spark.read.parquet(f"{tmp_dir}/c").count() == 3


def test_chunked_files(spark, tmp_dir):
    SK.sink_chunked(spark.range(0, 2500, numPartitions=2), f"{tmp_dir}/k", chunk_rows=1000)
    sizes = [pq.ParquetFile(p).metadata.num_rows for p in glob.glob(f"{tmp_dir}/k/*.parquet")]
    assert sum(sizes) == 2500 and max(sizes) <= 1000


def test_load_metrics(spark, tmp_dir):
    df = spark.range(7)
    SK.sink_append(df, f"{tmp_dir}/m")
    r = SK.load_with_metrics(spark, df, f"{tmp_dir}/m").first()
    assert (r.rows_loaded, r.total_rows) == (7, 14)


def test_csv_without_header(spark, tmp_dir):
    SK.sink_csv(spark.createDataFrame([("a", 1)], "x string, y int"), f"{tmp_dir}/csv", header=False)
    text = "".join(open(p).read() for p in glob.glob(f"{tmp_dir}/csv/*.csv"))
    assert text == "a;1\n"


def test_stream_ingest_exactly_once(spark, tmp_dir):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    land = f"{tmp_dir}/land"
    os.makedirs(land)
    open(f"{land}/f1.csv", "w").write("a;b\n1;x\n2;NA\n")
    out, ck = f"{tmp_dir}/out", f"{tmp_dir}/ck"
    ingest_stream(spark, land, schema, out, ck)
    ingest_stream(spark, land, schema, out, ck)  # nothing new: no duplicate load
    open(f"{land}/f2.csv", "w").write("a;b\n3;y\n")
    ingest_stream(spark, land, schema, out, ck)
    got = sorted((r.a, r.b, r.file_name) for r in spark.read.parquet(out).collect())
    assert got == [("1", "x", "f1.csv"), ("2", None, "f1.csv"), ("3", "y", "f2.csv")]


def test_append_by_position(spark, tmp_dir):
    SK.sink_append(spark.createDataFrame([(1, "a")], "Data int, Zona string"), f"{tmp_dir}/p")
    SK.sink_append(spark.createDataFrame([(2, "b")], "_c0 int, _c1 string"), f"{tmp_dir}/p", by_position=True)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_dir}/p").collect())
    assert got == [(1, "a"), (2, "b")]


def test_file_job_stream_exactly_once(spark, tmp_dir):
    from tessera.plans import jobs as JB
    from tessera.streaming.ingest import ingest_files
    from test_sources import registry_text
    land, out, ck = f"{tmp_dir}/land", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    os.makedirs(land)
    open(f"{land}/202401_a.csv", "w").write(registry_text(JB.MONTH_ORDER))
    job = lambda s, paths: JB.registry_import(s, paths, "2024-11-25 06:30:00")
    ingest_files(spark, land, job, out, ck, pattern="*.csv")
    ingest_files(spark, land, job, out, ck, pattern="*.csv")  # nothing new
    open(f"{land}/202402_b.csv", "w").write(registry_text(list(reversed(JB.MONTH_ORDER))))
    ingest_files(spark, land, job, out, ck, pattern="*.csv")
    got = sorted((r.Anno, r.Mese) for r in spark.read.parquet(out).collect())
    assert got == [(2024, 2), (2024, 3)]


def test_two_sources_into_one_target_keep_all_rows(spark, tmp_dir):
    from tessera.streaming.ingest import ingest_files
    for name in ("one", "two"):
        os.makedirs(f"{tmp_dir}/{name}")
        open(f"{tmp_dir}/{name}/a.csv", "w").write(f"A;B\n{name};1\n")
    job = lambda s, paths: CSV.scan_csv_text(s, paths)
    for name in ("one", "two", "one"):
        ingest_files(spark, f"{tmp_dir}/{name}", job, f"{tmp_dir}/target", f"{tmp_dir}/ckpt-{name}")
    assert sorted(r.A for r in spark.read.parquet(f"{tmp_dir}/target").collect()) == ["one", "two"]


def test_stream_refuses_long_rows_and_other_headers(spark, tmp_dir):
    from pyspark.sql import types as T

    from tessera.streaming.ingest import ingest_stream
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("A", "B")])
    os.makedirs(f"{tmp_dir}/in")
    open(f"{tmp_dir}/in/a.csv", "w").write("A;B\n1;2\n3;4;5\n")
    with pytest.raises(Exception, match="more fields"):
        ingest_stream(spark, f"{tmp_dir}/in", schema, f"{tmp_dir}/t1", f"{tmp_dir}/c1")
    ingest_stream(spark, f"{tmp_dir}/in", schema, f"{tmp_dir}/t2", f"{tmp_dir}/c2", long_rows="drop")
    assert [(r.A, r.B) for r in spark.read.parquet(f"{tmp_dir}/t2").collect()] == [("1", "2")]
    os.makedirs(f"{tmp_dir}/in2")
    open(f"{tmp_dir}/in2/b.csv", "w").write("B;A\n2;1\n")
    with pytest.raises(Exception, match="header"):
        ingest_stream(spark, f"{tmp_dir}/in2", schema, f"{tmp_dir}/t3", f"{tmp_dir}/c3")
