"""What is kept up to date: one file written by many tasks, keyed tables, ledger summaries, run status, replayed batches."""

import itertools
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import ledger as L
from tessera.operators import status as ST
from tessera.plans import refunds as J
from tessera.sinks import assemble as AS
from tessera.sinks import fixed_width as FW
from tessera.sinks.keyed import KeyedTable
from tessera.streaming import ingest as IN
from tessera.streaming import status as SS
from test_ledger_random import SCHEMAS, as_sets, expected, random_ledger


# ---- one file from many parts -------------------------------------------------------------------

@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16-le"])
@pytest.mark.parametrize("header,drop", [(None, True), ("Città;n", False)])
def test_assembled_file_equals_the_merged_one(spark, tmp_dir, encoding, header, drop):
    r = random.Random(1)
    os.makedirs(f"{tmp_dir}/parts")
    for n in range(7):
        with open(f"{tmp_dir}/parts/part-{n * 30_000:05d}-x.txt", "wb") as fh:
            lines = "".join("è" * r.randrange(30) + f"{k}" + r.choice(["\n", "\r\n"]) for k in range(0 if n == 3 else 200))
            fh.write(lines.encode())
    open(f"{tmp_dir}/parts/_SUCCESS", "w").close()
    FW.merge_parts(f"{tmp_dir}/parts", f"{tmp_dir}/merged", drop_final_newline=drop and encoding != "utf-16-le", header=header, encoding=encoding)
    size = AS.assemble_parts(spark, f"{tmp_dir}/parts", f"{tmp_dir}/out/assembled", drop_final_newline=drop and encoding != "utf-16-le", header=header, encoding=encoding, range_bytes=777)
    want = open(f"{tmp_dir}/merged", "rb").read()
    assert open(f"{tmp_dir}/out/assembled", "rb").read() == want and size == len(want)
    assert os.listdir(f"{tmp_dir}/out") == ["assembled"]


def test_ranges_are_written_by_many_tasks(spark, tmp_dir):
    spark.range(0, 4000, numPartitions=3).select(F.format_string("%08d", "id").alias("line")).write.text(f"{tmp_dir}/parts")
    ranges = AS.part_ranges(spark, f"{tmp_dir}/parts", 4096)
    assert ranges.rdd.getNumPartitions() == ranges.count() > 8
    placed = sorted((x.at, x.at + x.size) for x in AS.placed_ranges(ranges, 5, None).collect())
    assert placed[0][0] == 5 and placed[-1][1] == 5 + 4000 * 9 and all(a[1] == b[0] for a, b in zip(placed, placed[1:], strict=False))
    assert AS.assemble_parts(spark, f"{tmp_dir}/parts", f"{tmp_dir}/all.txt", range_bytes=4096) == 4000 * 9 - 1
    assert open(f"{tmp_dir}/all.txt").read().split("\n") == [f"{i:08d}" for i in range(4000)]


def test_no_parts_give_an_empty_file(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/parts")
    assert AS.assemble_parts(spark, f"{tmp_dir}/parts", f"{tmp_dir}/none.txt") == 0
    assert open(f"{tmp_dir}/none.txt").read() == ""


# ---- keyed tables -------------------------------------------------------------------------------

def test_keyed_table_against_a_dict(spark, tmp_dir):
    """Random batches, some run twice; every read, also of earlier states, equals a dict's."""
    r = random.Random(2)
    table = KeyedTable(spark, f"{tmp_dir}/t", "k string, n long", ["k"], lambda d: d.groupBy("k").agg(F.sum("n").alias("n")), buckets=4)
    assert table.read().count() == 0
    held, states = {}, []
    for batch in range(4):
        rows = [(r.choice("abcdefgh") if r.random() < 0.9 else None, r.randrange(10)) for _ in range(r.choice([0, 1, 6]) if batch else 5)]
        for _ in range(1 + r.randrange(2)):
            table.merge(batch, spark.createDataFrame(rows, "k string, n long"))
        for k, n in rows:
            held[k] = held.get(k, 0) + n
        states.append(dict(held))
        assert dict(table.read().collect()) == held
    assert dict(table.read(before=2).collect()) == states[1]


def test_only_touched_buckets_are_rewritten(spark, tmp_dir):
    table = KeyedTable(spark, f"{tmp_dir}/t", "k long, n long", ["k"], lambda d: d.groupBy("k").agg(F.sum("n").alias("n")), buckets=16)
    table.merge(0, spark.range(1000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")))
    assert table.merge(1, spark.createDataFrame([(7, 5)], "k long, n long")) == 1
    assert len([d for d in os.listdir(f"{tmp_dir}/t/rows/batch=1") if d.startswith("bucket=")]) == 1
    assert table.read().agg(F.count("*"), F.sum("n")).first() == (1000, 1005)
    # rows of a batch without its list are not there
    spark.createDataFrame([(7, 99, 3)], "k long, n long, bucket int").write.partitionBy("bucket").parquet(f"{tmp_dir}/t/rows/batch=2")
    assert table.read().agg(F.sum("n")).first()[0] == 1005


def test_a_batch_writes_its_own_rows(spark, tmp_dir):
    """A batch that touches every bucket writes what it brings, not the table; many versions are written whole at last."""
    table = KeyedTable(spark, f"{tmp_dir}/t", "k long, n long", ["k"], lambda d: d.groupBy("k").agg(F.sum("n").alias("n")), buckets=2, versions=3)
    written = lambda b: spark.read.parquet(f"{tmp_dir}/t/rows/batch={b}").count()
    ones = lambda n: spark.range(n).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
    table.merge(0, ones(1000).unionByName(ones(1000)))
    assert written(0) == 1000
    for batch in range(1, 9):
        for _ in range(2):
            assert table.merge(batch, ones(10)) == 2
        assert written(batch) == (1000 if batch in (3, 6) else 10)
        assert table.read().agg(F.count("*"), F.sum("n")).first() == (1000, 2000 + 10 * batch)
        assert table.read(combined=False).agg(F.sum("n")).first()[0] == 2000 + 10 * batch
        assert table.read(before=batch).agg(F.count("*"), F.sum("n")).first() == (1000, 2000 + 10 * (batch - 1))
    # versions of a list without marks are whole
    spark.createDataFrame([(7, 5)], "k long, n long").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_dir}/t/rows/batch=9")
    spark.createDataFrame([(0,), (1,)], "bucket int").write.parquet(f"{tmp_dir}/t/commits/batch=9")
    assert [tuple(x) for x in table.read().collect()] == [(7, 5)]


# ---- ledger summaries ---------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [3, 4, 5])
def test_summary_and_deltas_equal_the_recount(spark, tmp_dir, seed):
    """Entries and details come in batches, details also for old entries; candidates read the summary only."""
    data = dict(zip(["cus", "acc", "ent", "det", "exc"], random_ledger(seed), strict=True))
    dfs = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in data.items()}
    r = random.Random(seed)
    came = {e[0]: r.randrange(3) for e in data["ent"]}
    due = [max(came[d[0]], r.randrange(4)) for d in data["det"]]
    table = L.summary_table(spark, f"{tmp_dir}/summary", buckets=4)
    frame = lambda kind, rows: spark.createDataFrame(rows, SCHEMAS[kind])
    for batch in (0, 1, 2, 2, 3):
        L.update_summary(table, batch, frame("ent", [e for e in data["ent"] if came[e[0]] < batch]), frame("ent", [e for e in data["ent"] if came[e[0]] == batch]),
                         frame("det", [d for d, b in zip(data["det"], due, strict=True) if b == batch]))
    recount = L.combine_summaries(L.entry_amounts(dfs["ent"], dfs["det"]))
    assert as_sets(table.read().collect()) == as_sets(recount.collect())
    domiciled, ordinary, movements = expected(data)

    class OnlySummary:
        accounts, customers, excluded = dfs["acc"], dfs["cus"], dfs["exc"]

    run = J.DomiciledRun(OnlySummary, J.params("domiciled"), documents=True, summary=table.read())
    assert as_sets(run.candidates().select("Cliente", "SaldoCliente", "CF").collect()) == as_sets(domiciled)
    assert as_sets(run.movements().select("Cliente", "Nrdocumento", "ImportoResiduoCompleto").collect()) == as_sets(movements)
    got = J.ordinary_candidates(OnlySummary, summary=table.read()).select("Fornitura", "SaldoFornitura", "Cliente", "SaldoCliente")
    assert as_sets(got.collect()) == as_sets(ordinary)


def test_entries_of_some_numbers(spark):
    """Of the old entries an update is handed those of its details; they are told apart before orders are joined to them."""
    from tessera.plans import fixtures as X
    sf = "/root/testdata/sf0.001"
    numbers = spark.range(3000).select((F.col("id") * 7).alias("EntryNo"))
    some = X.entries_of(spark, sf, numbers.union(numbers))
    want = X.entries(spark, sf).where("EntryNo % 7 = 0 and EntryNo < 21000")
    assert as_sets(some.collect()) == as_sets(want.collect()) and want.count() > 100
    assert some.count() == want.count()
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Inner") < plan.index("LeftSemi")


def test_an_update_reads_no_old_details(spark, tmp_dir):
    """A detail for an old entry adds to its sums; a document note counts in one of them only."""
    table = L.summary_table(spark, f"{tmp_dir}/s", buckets=2)
    ent = spark.createDataFrame([(1, "C", "A", "FT1"), (2, "C", "A", "CRP2"), (3, None, None, None)], SCHEMAS["ent"])
    none = lambda k: spark.createDataFrame([], SCHEMAS[k])
    L.update_summary(table, 0, none("ent"), ent, none("det"))
    assert as_sets(table.read().collect()) == as_sets([("C", "A", "FT1", None, None), ("C", "A", "CRP2", None, None), (None, None, None, None, None)])
    det = spark.createDataFrame([(1, Decimal("2.50")), (2, Decimal("1.00")), (3, Decimal("4.00"))], SCHEMAS["det"])
    L.update_summary(table, 1, ent, none("ent"), det)
    L.update_summary(table, 2, ent, none("ent"), det.where("CustLedgerEntryNo = 1"))
    assert as_sets(table.read().collect()) == as_sets([("C", "A", "FT1", "5.00", "5.00"), ("C", "A", "CRP2", "1.00", None), (None, None, None, "4.00", None)])


# ---- run status from a stream -------------------------------------------------------------------

EVENTS = "day date, pipeline string, status string, ts timestamp_ntz, run_id long"


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_status_of_a_stream_in_any_order(spark, tmp_dir, order):
    import datetime as dt
    r = random.Random(11)
    rows = [(dt.date(2024, 11, 1 + d), f"p{p}", r.choice(["COMPLETED", "RUNNING", "REJECTED", "PENDING"]), dt.datetime(2024, 11, 1 + d, r.randrange(4)), k)
            for k, (d, p) in enumerate((r.randrange(3), r.randrange(4)) for _ in range(60))]
    table = SS.status_table(spark, f"{tmp_dir}/status", {"day": "date", "pipeline": "string"}, buckets=2)
    os.makedirs(f"{tmp_dir}/in")
    for wave in order:
        spark.createDataFrame(rows[wave::3], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
        SS.follow_status(spark.readStream.schema(EVENTS).parquet(f"{tmp_dir}/in"), table, f"{tmp_dir}/ck")
    SS.follow_status(spark.readStream.schema(EVENTS).parquet(f"{tmp_dir}/in"), table, f"{tmp_dir}/ck")  # nothing new
    batch = ST.latest_run(spark.createDataFrame(rows, EVENTS), ["day", "pipeline"], "ts", "run_id")
    want = batch.select("day", F.col("pipeline").alias("name"), "status").unionByName(ST.status_rollup(batch, ["day"], out="status").select("day", F.lit("GROUP").alias("name"), "status"))
    assert as_sets(SS.pipeline_status(table, "pipeline", ["day"]).collect()) == as_sets(want.collect())


def test_state_is_only_forgotten_by_time(spark, tmp_dir):
    table = SS.status_table(spark, f"{tmp_dir}/status", {"pipeline": "string"})
    with pytest.raises(ValueError, match="hold the time"):
        SS.follow_status(spark.readStream.format("rate").load(), table, f"{tmp_dir}/ck", forget_after="1 day")


# ---- batches that run again ---------------------------------------------------------------------

def test_a_failed_batch_is_replayed_once(spark, tmp_dir):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b")])
    table = f"replayed_{os.getpid()}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")

    def fail(batch):
        raise RuntimeError("after the write")

    try:
        for source in ("one", "two"):
            os.makedirs(f"{tmp_dir}/{source}")
            for n in range(3):
                open(f"{tmp_dir}/{source}/f{n}.csv", "w").write(f"a;b\n{source};{n}\n")
            run = lambda s=source, **more: IN.ingest_table(spark, f"{tmp_dir}/{s}", schema, table, f"{tmp_dir}/ck-{s}", max_files_per_trigger=2, **more)
            for _ in range(2):
                with pytest.raises(Exception, match="after the write"):
                    run(after_batch=fail)
            run()
            run()
        got = sorted((r.a, r.b) for r in spark.table(table).collect())
        assert got == sorted((s, str(n)) for s in ("one", "two") for n in range(3))
        assert spark.table(table).select("source_id", "batch_id").distinct().count() == 4
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_write_batch_replaces_its_own_rows_only(spark):
    table = f"batches_{os.getpid()}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    rows = lambda *v: spark.createDataFrame([(x, x) for x in v], "a string, b string")
    try:
        IN.write_batch(rows("1", "2"), table, "s", 0)
        IN.write_batch(rows("3"), table, "s", 1)
        IN.write_batch(rows("4"), table, "t", 0)
        IN.write_batch(rows("5").select("b"), table, "s", 0)
        assert sorted((r.a, r.b) for r in spark.table(table).collect() if r.a) == [("3", "3"), ("4", "4")]
        assert [(r.a, r.b) for r in spark.table(table).collect() if not r.a] == [(None, "5")]
        IN.write_batch(rows().where("false"), table, "s", 0)
        assert sorted(r.b for r in spark.table(table).collect()) == ["3", "4"]
        with pytest.raises(ValueError, match="no columns"):
            IN.write_batch(rows("6").withColumn("c", F.lit(1)), table, "s", 2)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
