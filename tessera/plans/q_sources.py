"""Checked queries for file sources and the ingest jobs. Each stages landing files derived from the
driver tables, then runs the real scan/job on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import pad_left
from ..sources import archives as A
from ..sources import csv as CSV
from ..sources import preamble as P
from ..sources import xml as XML
from . import fixtures as X
from . import jobs as JB
from . import oracle as O
from . import staging as S
from .registry import register


def _t(spark, sf, name):
    return X.read_table(spark, sf, name)


# ---- orders as a delimited landing file --------------------------------------------------------

def orders_text(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                    pad_left(F.col("o_custkey").cast("string"), "0", 8).alias("o_custkey"),
                    "o_orderstatus",
                    F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("o_totalprice"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                    "o_orderpriority")


def stage_two_orders(spark, sf):
    """One folder of delimited files whose columns stand in two orders."""
    dest, o = S.fresh(spark, "orders-csv"), orders_text(spark, sf)
    S.stage_csv(o.where(F.col("o_orderstatus") != "F"), f"{dest}/a")
    S.stage_csv(o.where(F.col("o_orderstatus") == "F").select(*reversed(o.columns)), f"{dest}/b")
    return dest


ORDERS_TEXT_SQL = f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {O.pad_left('CAST(o_custkey AS VARCHAR)', '0', 8)} AS o_custkey,
       o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


@register("scan_csv_text", ORDERS_TEXT_SQL)
def scan_csv_text(spark, sf):
    return CSV.scan_csv_text(spark, stage_two_orders(spark, sf), sep=";", encoding=CSV.LATIN1)


@register("scan_csv_typed", f"""SELECT o_orderkey, {O.pad_left('CAST(o_custkey AS VARCHAR)', '0', 8)} AS o_custkey, o_orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
       o_orderpriority FROM orders""")
def scan_csv_typed(spark, sf):
    path = stage_two_orders(spark, sf)
    types = {"o_orderkey": "bigint", "o_totalprice": "decimal(12,2)", "o_orderdate": "date"}
    return CSV.scan_csv_typed(spark, path, types)


def ragged_lines(spark, sf):
    li = _t(spark, sf, "lineitem")
    base = [F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_returnflag"),
            F.col("l_linestatus")]
    # long rows: one extra field, and an empty one before it
    line = (F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 2 == 0), F.concat_ws(";", *base, F.lit(""), F.lit("EXTRA")))
            .when(F.col("l_linenumber") == 7, F.concat_ws(";", *base, F.lit("EXTRA")))
            .when(F.col("l_linenumber") == 1, F.concat_ws(";", *base[:3]))
            .otherwise(F.concat_ws(";", *base)))
    return li.select(F.lit("lines").alias("k"), F.lit("l_orderkey;l_linenumber;l_returnflag;l_linestatus").alias("h"),
                     line.alias("t"))


@register("scan_csv_bad_rows", """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       l_returnflag, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linestatus END AS l_linestatus
FROM lineitem WHERE l_linenumber <> 7""")
def scan_csv_bad_rows(spark, sf):
    dest = S.fresh(spark, "ragged")
    S.write_text_files(ragged_lines(spark, sf), dest, "k", "h", "t", encoding="ISO-8859-1")
    return CSV.scan_csv_bad_rows(spark, dest)


@register("scan_csv_line_breaks", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus || chr(10) || '"' || o_orderpriority || '";' AS note,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def scan_csv_line_breaks(spark, sf):
    """Fields with line breaks, quotes and separators, in files cut into ranges of 64 KB."""
    o = _t(spark, sf, "orders")
    note = F.concat("o_orderstatus", F.lit("\n\""), "o_orderpriority", F.lit('";'))
    text = o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), note.alias("note"),
                    F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    dest = S.stage_csv(text, S.fresh(spark, "orders-notes"))
    return CSV.scan_csv_text(spark, dest, range_bytes=64 << 10)


@register("scan_csv_many_headers", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CASE WHEN c_nationkey % 2 = 0 THEN 'n' || CAST(c_custkey AS VARCHAR) END AS even FROM customer""")
def scan_csv_many_headers(spark, sf):
    """One file a nation and partition, each nation with its columns in another order and every other one with a column more; one scan."""
    from itertools import permutations

    c = _t(spark, sf, "customer")
    names = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]
    orders = [list(p) for p in permutations(names)]
    key = F.col("c_nationkey") % 24
    even = F.col("c_nationkey") % 2 == 0
    more = F.concat(F.lit(";n"), F.col("c_custkey").cast("string"))
    pick = lambda build: F.element_at(F.array(*[build(o) for o in orders]), (key + 1).cast("int"))
    head = F.concat(pick(lambda o: F.lit(";".join(o))), F.when(even, ";even").otherwise(""))
    line = F.concat(pick(lambda o: F.concat_ws(";", *[F.col(n).cast("string") for n in o])), F.when(even, more).otherwise(""))
    dest = S.fresh(spark, "customer-orders")
    S.write_text_files(c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("k"), head.alias("h"), line.alias("t")), dest, "k", "h", "t", encoding="ISO-8859-1")
    return CSV.scan_csv_text(spark, dest)


@register("split_long_rows", """SELECT CASE WHEN l_linenumber = 7 THEN 'long' ELSE 'good' END AS rows, count(*) AS n, count(*) AS observed,
       count(CASE WHEN l_linenumber <> 7 THEN 1 END) AS keys, count(CASE WHEN l_linenumber NOT IN (1, 7) THEN 1 END) AS statuses FROM lineitem GROUP BY 1""")
def split_long_rows(spark, sf):
    """Good and long rows apart, written in one pass: rows in each output, and the counts observed by the write."""
    dest, out = S.fresh(spark, "ragged"), S.fresh(spark, "split")
    S.write_text_files(ragged_lines(spark, sf), dest, "k", "h", "t", encoding="ISO-8859-1")
    seen = CSV.split_long_rows(spark, dest, out)
    observed = F.when(F.col("rows") == "good", F.lit(seen["good"])).otherwise(F.lit(seen["long"])).cast("long")
    written = spark.read.parquet(out).groupBy("rows").agg(F.count(F.lit(1)).alias("n"), F.count("l_orderkey").alias("keys"), F.count("l_linestatus").alias("statuses"))
    return written.select(F.col("rows").cast("string").alias("rows"), "n", observed.alias("observed"), "keys", "statuses")


@register("null_tokens", """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name,
       CASE WHEN p_size IN (1, 2, 3, 4) THEN NULL ELSE p_brand END AS p_brand, p_type FROM part""")
def null_tokens(spark, sf):
    p = _t(spark, sf, "part")
    brand = (F.when(F.col("p_size") == 1, "NA").when(F.col("p_size") == 2, "NULL").when(F.col("p_size") == 3, "n/a")
             .when(F.col("p_size") == 4, "").otherwise(F.col("p_brand")))
    staged = p.select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", brand.alias("p_brand"), "p_type")
    path = S.stage_csv(staged, S.fresh(spark, "part-csv"))
    return CSV.scan_csv_text(spark, path)


@register("union_files", """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events""")
def union_files(spark, sf):
    """Files of one folder with different column orders, appended by name (UNION ALL over files)."""
    e = _t(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"),
                                       F.col("user_id").cast("string").alias("user_id"), "event_type",
                                       F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    a_dest, b_dest = S.fresh(spark, "events-a"), S.fresh(spark, "events-b")
    S.stage_csv(e.where(F.col("event_type") < "p"), a_dest)
    S.stage_csv(e.where(F.col("event_type") >= "p").select("ts", "event_type", "user_id", "event_id"), b_dest)
    return JB.union_files(spark, [a_dest, b_dest])


# ---- registry files with a preamble ------------------------------------------------------------

@register("scan_preamble_csv", JB.REGISTRY_PREAMBLE_SQL)
def scan_preamble_csv(spark, sf):
    dest = JB.stage_registry_files(spark, sf)
    rows = P.scan_preamble_csv(spark, dest)
    return rows.select(P.field("POD").alias("POD"), "company", "zone", "vat")


@register("job_registry_import", JB.REGISTRY_SQL)
def job_registry_import(spark, sf):
    dest = JB.stage_registry_files(spark, sf)
    return JB.registry_import(spark, dest, load_ts=JB.LOAD_TS)


# ---- XML prices ---------------------------------------------------------------------------------

@register("scan_xml_rows", JB.PRICE_ROWS_SQL)
def scan_xml_rows(spark, sf):
    dest = JB.stage_price_files(spark, sf)
    return XML.scan_xml_rows(spark, dest)


@register("job_price_import", JB.PRICE_IMPORT_SQL)
def job_price_import(spark, sf):
    dest = JB.stage_price_files(spark, sf)
    return JB.price_import(spark, dest, JB.PRICE_START, JB.PRICE_END, load_ts=JB.LOAD_TS)


# ---- archives -----------------------------------------------------------------------------------

@register("expand_archives", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def expand_archives(spark, sf):
    c = _t(spark, sf, "customer")
    text = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    dest = S.fresh(spark, "zips")
    half = F.col("c_mktsegment") < "H"
    A.write_archives(c.where(half).select(text.alias("t")), dest, "t", "clienti_{tag}.csv", nested=False,
                     header="c_custkey;c_name;c_mktsegment")
    A.write_archives(c.where(~half).select(text.alias("t")), dest, "t", "clienti_{tag}.csv", nested=True,
                     header="c_custkey;c_name;c_mktsegment")
    lines = A.archive_lines(spark, dest).where(F.col("pos") > 0)
    f = F.split("line", ";", -1)
    return lines.select(F.element_at(f, 1).alias("c_custkey"), F.element_at(f, 2).alias("c_name"),
                        F.element_at(f, 3).alias("c_mktsegment"))


@register("job_supply_point_import", JB.SUPPLY_POINT_SQL)
def job_supply_point_import(spark, sf):
    dest = JB.stage_supply_point_archives(spark, sf)
    return JB.supply_point_import(spark, dest, S.fresh(spark, "rcu-extracted"), load_ts=JB.LOAD_TS)
