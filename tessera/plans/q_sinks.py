"""Checked queries for sinks (round trips through shared storage), the export/load jobs and the
streaming landing-folder ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pad_left
from ..sinks import fixed_width as FW
from ..sinks import tables as SK
from ..sources import csv as CSV
from ..streaming.ingest import ingest_stream
from . import fixtures as X
from . import jobs as JB
from . import oracle as O
from . import q_ledger as QL
from . import refunds as J
from . import staging as S
from .q_sources import ORDERS_TEXT_SQL, orders_text
from .registry import register


def _t(spark, sf, name):
    return X.read_table(spark, sf, name)


CUSTOMER_SQL = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_TEXT_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer"""


def customer_text(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
                    F.col("c_nationkey").cast("string").alias("c_nationkey"),
                    F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("c_acctbal"), "c_mktsegment")


@register("sink_csv", CUSTOMER_TEXT_SQL)
def sink_csv(spark, sf):
    dest = S.fresh(spark, "sink-csv")
    SK.sink_csv(customer_text(spark, sf), dest, sep=";", header=True, encoding="ISO-8859-1")
    return CSV.scan_csv_text(spark, dest, sep=";", encoding=CSV.LATIN1, tokens=[])


@register("sink_append", f"{CUSTOMER_SQL} UNION ALL {CUSTOMER_SQL}")
def sink_append(spark, sf):
    dest = S.fresh(spark, "sink-append")
    c = _t(spark, sf, "customer")
    SK.sink_append(c, dest)
    SK.sink_append(c, dest)  # no de-duplication: the second load doubles the rows
    return spark.read.parquet(dest)


@register("sink_overwrite", CUSTOMER_SQL)
def sink_overwrite(spark, sf):
    dest = S.fresh(spark, "sink-overwrite")
    c = _t(spark, sf, "customer")
    SK.sink_overwrite(c, dest)
    SK.sink_overwrite(c, dest)
    return spark.read.parquet(dest)


@register("sink_create_only", f"SELECT *, true AS first_ok, false AS second_ok FROM ({CUSTOMER_SQL}) c")
def sink_create_only(spark, sf):
    dest = S.fresh(spark, "sink-create") + "/table"
    c = _t(spark, sf, "customer")
    ok1, _ = SK.sink_create_only(c, dest)
    ok2, _ = SK.sink_create_only(c, dest)  # exists → error returned as a value
    return spark.read.parquet(dest).withColumns({"first_ok": F.lit(ok1), "second_ok": F.lit(ok2)})


@register("sink_chunked", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag FROM lineitem")
def sink_chunked(spark, sf):
    dest = S.fresh(spark, "sink-chunked")
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    chunk = max(1, li.count() // 25)  # several files for every task, whatever the table's size
    SK.sink_chunked(li, dest, chunk_rows=chunk)
    written = spark.read.parquet(dest)
    largest = written.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0]
    if largest > chunk:
        raise AssertionError(f"a file holds {largest} rows, more than {chunk}")
    return written


@register("sink_schema_mode", """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
       o_orderpriority FROM orders""")
def sink_schema_mode(spark, sf):
    """Load with autodetected types (declared mode is ``scan_csv_typed``)."""
    dest = S.stage_csv(orders_text(spark, sf).withColumn("o_custkey", F.col("o_custkey").cast("bigint").cast("string")),
                       S.fresh(spark, "schema-mode"), encoding="UTF-8")
    return CSV.scan_csv_inferred(spark, dest, sep=";")


@register("load_metrics", "SELECT count(*) AS rows_loaded, 2 * count(*) AS total_rows FROM lineitem")
def load_metrics(spark, sf):
    dest = S.fresh(spark, "load-metrics")
    li = _t(spark, sf, "lineitem")
    SK.sink_append(li, dest)
    return SK.load_with_metrics(spark, li, dest, mode="append")


DOM_LINES_SQL = QL._w_lines(QL.DOM_N, f"SELECT line AS value FROM ({QL.DOM_LINES}) t")


@register("sink_fixed_width", DOM_LINES_SQL)
def sink_fixed_width(spark, sf):
    dest = S.fresh(spark, "bonifici")
    FW.sink_payment_blocks(J.domiciled_run(spark, sf).blocks(), dest)
    return spark.read.text(dest)


@register("scan_fixed_width", QL._w_lines(QL.DOM_N, f"SELECT substr(line, 57, 30) AS CodiceUnivoco FROM ({QL.DOM_LINES}) t WHERE line LIKE ' 70%'"))
def scan_fixed_width(spark, sf):
    dest = S.fresh(spark, "bonifici")
    FW.sink_fixed_width(J.lines_domiciled(spark, sf), dest)
    return FW.scan_fixed_width(spark, dest)


@register("sink_movements", QL.MOVEMENTS_SQL, double=("SaldoCliente", "ImportoResiduoCompleto"))
def sink_movements(spark, sf):
    """Reconciliation table written as Parquet (workbook codec not built) and read back; the keys
    come from the written payment file, as in the reference."""
    run = J.domiciled_run(spark, sf, documents=True)
    lines_dest = S.fresh(spark, "bonifici")
    FW.sink_payment_blocks(run.blocks(), lines_dest)
    mv = run.movements(lines=spark.read.text(lines_dest).select(F.col("value").alias("line")))
    dest = S.fresh(spark, "movimenti")
    SK.sink_overwrite(mv, dest)
    return spark.read.parquet(dest)


# ---- jobs ---------------------------------------------------------------------------------------

def offer_library_tables(spark, sf):
    """A folder with a sheet of each kind, routed to its table; the two targets."""
    folder, gas, electricity = S.fresh(spark, "librerie"), S.fresh(spark, "libreria-gas"), S.fresh(spark, "libreria-ee")
    JB.gas_sheet(spark, sf).write.parquet(f"{folder}/libreria_offerte_gas.parquet")
    JB.electricity_sheet(spark, sf).write.parquet(f"{folder}/libreria_offerte_ee.parquet")
    JB.offer_libraries(spark, folder, gas, electricity)
    return gas, electricity


@register("job_offer_library", JB.GAS_LIBRARY_SQL)
def job_offer_library(spark, sf):
    return spark.read.parquet(offer_library_tables(spark, sf)[0])


@register("job_offer_library_electricity", JB.ELECTRICITY_LIBRARY_SQL)
def job_offer_library_electricity(spark, sf):
    return spark.read.parquet(offer_library_tables(spark, sf)[1])


MESSY = {"c_custkey": "Cod. Cliente", "c_name": "Ragione Sociale (Nome)", "c_nationkey": "Nazione/Paese",
         "c_acctbal": "Saldo [EUR] +/- Perché?", "c_mktsegment": "Settore #1 ° «più»"}


@register("job_table_from_csv", """SELECT CAST(c_custkey AS VARCHAR) AS "Cod_Cliente", c_name AS "Ragione_Sociale_Nome",
       CAST(c_nationkey AS VARCHAR) AS "NazionePaese", CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS "Saldo_EUR_-_Perch",
       c_mktsegment AS "Settore_1__«pi»" FROM customer""")
def job_table_from_csv(spark, sf):
    staged = customer_text(spark, sf).select(*[F.col(k).alias(v) for k, v in MESSY.items()])
    src = S.stage_csv(staged, S.fresh(spark, "csv-upload"), sep=",", encoding="ISO-8859-1")
    target = S.fresh(spark, "csv-table") + "/t"
    JB.table_from_csv(spark, src, target, sep=",")
    return spark.read.parquet(target)


@register("job_flow15_replace", ORDERS_TEXT_SQL)
def job_flow15_replace(spark, sf):
    folder = S.fresh(spark, "acusim")
    header = ";".join(orders_text(spark, sf).columns)
    text = F.concat_ws(";", *[F.coalesce(F.col(c), F.lit("")) for c in orders_text(spark, sf).columns])
    staged = orders_text(spark, sf).select(F.lit("x").alias("k"), F.lit(header).alias("h"), text.alias("t"))
    S.write_text_files(staged, folder, "k", "h", "t", name_fmt="FLUSSO_ACUSIM_15_{tag}.csv", encoding="ISO-8859-1")
    target = S.fresh(spark, "acusim-table")
    JB.flow15_replace(spark, folder, target)
    return spark.read.parquet(target)


@register("job_share", f"""SELECT {O.pad_left('CAST(o_orderkey AS VARCHAR)', '0', 14)} AS PDR_fornitura,
       CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders""")
def job_share(spark, sf):
    import uuid
    view = f"orders_{uuid.uuid4().hex[:8]}"
    _t(spark, sf, "orders").createOrReplaceTempView(view)
    dest = S.fresh(spark, "share")
    JB.share_export(spark, dest, sql=f"SELECT o_orderkey AS PDR_fornitura, o_custkey, o_orderstatus FROM {view}")
    return CSV.scan_csv_text(spark, dest, sep=";", encoding="UTF-8", tokens=[])


# ---- streaming ---------------------------------------------------------------------------------

ORDERS_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                    "o_orderpriority"]])


@register("ingest_stream", ORDERS_TEXT_SQL)
def ingest_stream_q(spark, sf):
    """Files dropped in two waves; two availableNow runs on one checkpoint load each file once."""
    folder = S.fresh(spark, "landing")
    target, ckpt = S.fresh(spark, "landed"), S.fresh(spark, "landing-ckpt")
    o = orders_text(spark, sf)
    S.stage_csv(o.where(F.col("o_orderstatus") == "F"), folder + "/wave1")
    ingest_stream(spark, folder + "/*", ORDERS_TEXT_SCHEMA, target, ckpt)
    S.stage_csv(o.where(F.col("o_orderstatus") != "F"), folder + "/wave2")
    ingest_stream(spark, folder + "/*", ORDERS_TEXT_SCHEMA, target, ckpt)
    return spark.read.parquet(target).drop("file_name")


@register("ingest_table", ORDERS_TEXT_SQL)
def ingest_table_q(spark, sf):
    """Files dropped in two waves, loaded into a catalog table; the last batch of each wave fails after its write and is run again."""
    import uuid

    from ..streaming.ingest import ingest_table
    folder, ckpt, table = S.fresh(spark, "landing"), S.fresh(spark, "landing-ckpt"), f"landed_{uuid.uuid4().hex[:8]}"
    o = orders_text(spark, sf)

    def fail(batch):
        raise RuntimeError("stopped after the write")
    for wave, rows in enumerate((o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") != "F"))):
        S.stage_csv(rows, f"{folder}/wave{wave}")
        try:
            ingest_table(spark, folder + "/*", ORDERS_TEXT_SCHEMA, table, ckpt, after_batch=fail)
        except Exception as e:  # noqa: BLE001 - the failure is the point
            if "stopped after the write" not in str(e):
                raise
        ingest_table(spark, folder + "/*", ORDERS_TEXT_SCHEMA, table, ckpt)
    return spark.table(table).drop("file_name", "source_id", "batch_id")
