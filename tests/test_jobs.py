"""Ingest/export jobs on tiny inputs: library routing, flow-15 name check, create-only CSV table, export."""

import glob
import os

from pyspark.sql import functions as F

from tessera.plans import jobs as JB


def test_offer_library_routes(spark):
    cols = [F.lit(i).alias(f"c{i:02d}") for i in range(60)]
    sheet = spark.range(2).select(*cols, F.lit("2024-03-05").alias("Inizio_Validit__"),
                                  F.lit("2025-03-05").alias("Fine_Validit__"))
    ee = JB.offer_library(sheet, "libreria_ee_2024")
    assert len(ee.columns) == 50
    gas_sheet = sheet.select("Inizio_Validit__", "Fine_Validit__", *[f"c{i:02d}" for i in range(40)])
    gas = JB.offer_library(gas_sheet, "libreria_gas_2024")
    assert len(gas.columns) == 27
    r = gas.first()
    assert (r.Inizio_Validit__, r.Fine_Validit__) == ("03/05/2024", "03/05/2025")


def test_flow15_name_check(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    open(f"{tmp_dir}/in/flusso_acusim.csv", "w").write("A;B\n1;2\n")
    assert JB.flow15_replace(spark, f"{tmp_dir}/in", f"{tmp_dir}/t") == JB.FLOW15_MISSING
    open(f"{tmp_dir}/in/flusso_15_acusim.csv", "w").write("A;B\n1;NA\n")
    assert JB.flow15_replace(spark, f"{tmp_dir}/in", f"{tmp_dir}/t") == "loaded"
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_dir}/t").collect()] == [("1", None)]


def test_table_from_csv_create_only(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.csv", "wb") as fh:
        fh.write("Cod. Cliente,Città (Prov)\n007,Forlì\n".encode("latin-1"))
    df, (ok, _) = JB.table_from_csv(spark, f"{tmp_dir}/in", f"{tmp_dir}/t", sep=",")
    assert ok and df.columns == ["Cod_Cliente", "Citt_Prov"]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_dir}/t").collect()] == [("007", "Forlì")]
    _, (ok2, msg) = JB.table_from_csv(spark, f"{tmp_dir}/in", f"{tmp_dir}/t", sep=",")
    assert not ok2 and msg.startswith("Errore")


def test_share_pads_pdr_columns(spark, tmp_dir):
    spark.createDataFrame([(123, "x"), (None, "y"), (123456789012345, "z")], "PDR long, v string") \
        .createOrReplaceTempView("share_src")
    JB.share_export(spark, f"{tmp_dir}/out", table="share_src", single_file=f"{tmp_dir}/export.csv")
    lines = open(f"{tmp_dir}/export.csv").read().split("\n")
    assert lines[0] == "PDR;v" and lines[-1] == ""
    assert sorted(lines[1:-1]) == sorted(["00000000000123;x", ";y", "123456789012345;z"])


def test_offer_libraries_of_a_folder(spark, tmp_dir):
    head = ";".join(["Inizio_Validit__", "Fine_Validit__", *[f"c{i}" for i in range(60)]])
    row = ";".join(["2024-03-05", "2025-03-05", *["x"] * 60])
    os.makedirs(f"{tmp_dir}/in")
    for name in ("libreria_gas_1.csv", "libreria_gas_2.csv", "libreria_ee.csv"):
        open(f"{tmp_dir}/in/{name}", "w").write(f"{head}\n{row}\n")
    assert JB.offer_libraries(spark, f"{tmp_dir}/in", f"{tmp_dir}/gas", f"{tmp_dir}/ee") == {"gas_library": 2, "electricity_library": 1}
    gas, ee = spark.read.parquet(f"{tmp_dir}/gas"), spark.read.parquet(f"{tmp_dir}/ee")
    assert (len(gas.columns), gas.count(), gas.first().Inizio_Validit__) == (27, 2, "03/05/2024")
    assert (len(ee.columns), ee.count(), ee.first().Inizio_Validit__) == (50, 1, "2024-03-05")


def test_catalog_targets(spark, tmp_dir):
    from tessera import api
    os.makedirs(f"{tmp_dir}/in")
    open(f"{tmp_dir}/in/flusso_15.csv", "w").write("A;B\n1;2\n")
    names = [f"t_{os.path.basename(tmp_dir).lower()}_{k}".replace("-", "_") for k in ("flow", "csv", "px")]
    try:
        assert api.replace_flow15(spark, f"{tmp_dir}/in", names[0], as_table=True) == "loaded"
        assert [tuple(r) for r in spark.table(names[0]).collect()] == [("1", "2")]
        assert api.load_csv_table(spark, f"{tmp_dir}/in", names[1], as_table=True)[0]
        assert not api.load_csv_table(spark, f"{tmp_dir}/in", names[1], as_table=True)[0]
        os.makedirs(f"{tmp_dir}/px")
        open(f"{tmp_dir}/px/20240105MGPPrezzi.xml", "w").write("<N><Prezzi><Data>20240105</Data><Ora>1</Ora><SUD>4,5</SUD></Prezzi></N>")
        for n in (1, 2):
            m = api.load_prices(spark, f"{tmp_dir}/px", "2024-01-05", "2024-01-05", names[2], "2024-11-25 06:30:00", as_table=True).first()
            assert (m.rows_loaded, m.total_rows) == (1, n)
        assert str(api.last_loaded_date(spark, names[2], as_table=True).first().max_date) == "2024-01-05"
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
