"""End-to-end user jobs through tessera.api on the smallest driver tables."""

import glob

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera import api
from tessera.operators.records import FileParams
from tessera.plans import fixtures as X
from tessera.plans import jobs as JB
from tessera.sinks.fixed_width import merge_parts

P = FileParams("domiciled", "2024-11-25", "run-t", "Servizi Energia S.p.A. Benefit")


def ledger(spark):
    return api.Ledger(X.accounts(spark, SF_SMALL), X.customers(spark, SF_SMALL), X.entries(spark, SF_SMALL),
                      X.details(spark, SF_SMALL), X.excluded(spark, SF_SMALL))


def test_domiciled_file_and_movements(spark, tmp_dir):
    out = api.domiciled_refund_file(ledger(spark), tmp_dir, P)
    assert out.n_payments == 82 and out.record_count == 7 * 82 + 2
    merge_parts(out.lines_path, f"{tmp_dir}/file.txt")
    lines = open(f"{tmp_dir}/file.txt").read().split("\n")
    assert len(lines) == out.record_count
    assert lines[0].startswith(" PC14191") and lines[-1].startswith(" EF")
    keys = {ln[56:86] for ln in lines if ln.startswith(" 70")}
    mv = spark.read.parquet(out.movements_path)
    assert mv.count() > 0
    assert {r.CodiceUnivoco for r in mv.select("CodiceUnivoco").distinct().collect()} <= keys


def test_ordinary_and_unallocated(spark, tmp_dir):
    o = api.ordinary_refund_file(ledger(spark), f"{tmp_dir}/o", FileParams("ordinary", "2024-11-25", "run-t"))
    assert o.n_payments == 90
    u = api.unallocated_refund_file(X.credits(spark, SF_SMALL), X.customers(spark, SF_SMALL), f"{tmp_dir}/u",
                                    FileParams("unallocated", "2024-11-25", "run-t", "Servizi Energia S.p.A. Benefit"))
    assert u.n_payments == 69
    text = spark.read.text(u.lines_path)
    assert text.count() == 7 * 69 + 2


def test_price_load_and_last_date(spark, tmp_dir):
    staged = JB.stage_price_files(spark, SF_SMALL)
    m = api.load_prices(spark, staged, "2024-01-03", "2024-01-05", f"{tmp_dir}/px", "2024-11-25 06:30:00").first()
    assert m.rows_loaded == m.total_rows > 0
    assert str(api.last_loaded_date(spark, f"{tmp_dir}/px").first().max_date) == "2024-01-05"


def test_pipeline_status(spark):
    runs = spark.createDataFrame([("a", 1, 1, "COMPLETED"), ("a", 2, 2, "RUNNING"), ("b", 1, 3, "COMPLETED")],
                                 "pipeline string, ts int, run_id int, status string")
    latest, group = api.pipeline_status(runs)
    assert {r.pipeline: r.status for r in latest.collect()} == {"a": "RUNNING", "b": "COMPLETED"}
    assert group.first().status == "In esecuzione"


def test_command_line_domiciled(spark, tmp_dir):
    import json
    import os
    import subprocess
    import sys
    for name, df in (("acc", X.accounts(spark, SF_SMALL)), ("cus", X.customers(spark, SF_SMALL)),
                     ("ent", X.entries(spark, SF_SMALL)), ("det", X.details(spark, SF_SMALL)),
                     ("exc", X.excluded(spark, SF_SMALL))):
        df.write.parquet(f"{tmp_dir}/{name}")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    cmd = [sys.executable, "-m", "tessera", "domiciled", "--out", f"{tmp_dir}/refund", "--run-id", "r1",
           "--run-date", "2024-11-25", "--payer-name", "Servizi Energia S.p.A. Benefit",
           "--accounts", f"{tmp_dir}/acc", "--customers", f"{tmp_dir}/cus", "--entries", f"{tmp_dir}/ent",
           "--details", f"{tmp_dir}/det", "--excluded", f"{tmp_dir}/exc"]
    res = subprocess.run(cmd, cwd=root, capture_output=True, text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    out = json.loads(res.stdout.strip().splitlines()[-1])
    assert out["n_payments"] == 82 and out["record_count"] == 7 * 82 + 2
    assert spark.read.text(out["lines_path"]).count() == out["record_count"]


def test_python_tasks_work_from_another_directory(tmp_dir):
    """mapInPandas tasks must import the package even when Spark starts outside the repository."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "import __spark_entry__ as E\n"
            "from pyspark.sql import SparkSession\n"
            "spark = SparkSession.builder.master('local[2]').getOrCreate()\n"
            "print('ROWS', E.queries()['expand_archives'](spark, %r).count())\n" % (root, SF_SMALL))
    res = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, capture_output=True, text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    assert "ROWS 150" in res.stdout


def test_bucketed_ledger_join_without_shuffle(spark, tmp_dir):
    from tessera.operators import ledger as L
    b = api.write_bucketed_ledger(ledger(spark), tmp_dir, buckets=4, prefix="t_")
    ea = L.entry_amounts(b.entries, b.details)
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = ea._jdf.queryExecution().executedPlan().toString()
        rows = sorted(tuple(r) for r in ea.collect())
    finally:
        spark.conf.set(key, old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = sorted(tuple(r) for r in L.entry_amounts(X.entries(spark, SF_SMALL), X.details(spark, SF_SMALL)).collect())
    assert rows == want
