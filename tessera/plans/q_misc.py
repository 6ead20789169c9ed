"""Checked queries for events (run status), listings, catalog scans and the pipeline-status job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import status as S
from ..operators.joins import semi_listing
from ..sources import listing as LS
from . import fixtures as X
from . import oracle as O
from . import staging as STG
from .registry import register


def _t(spark, sf, name):
    return X.read_table(spark, sf, name)


def runs(spark, sf):
    """Run events: purchase → COMPLETED, click → RUNNING, error → REJECTED, else PENDING."""
    e = _t(spark, sf, "events")
    st = (F.when(F.col("event_type") == "purchase", S.COMPLETED).when(F.col("event_type") == "click", S.RUNNING)
          .when(F.col("event_type") == "error", S.REJECTED).otherwise("PENDING"))
    return e.select("event_id", "ts", "user_id", st.alias("status"), F.to_date("ts").alias("day"), "value", "event_type")


RUNS_SQL = """runs AS (SELECT event_id, ts, user_id, CAST(ts AS DATE) AS day, value, event_type,
       CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'REJECTED'
       ELSE 'PENDING' END AS status FROM events)"""

ROLLUP_CASE = """CASE WHEN bool_or(status = 'COMPLETED') AND NOT bool_or(status = 'REJECTED') THEN 'In esecuzione'
            WHEN bool_or(status = 'RUNNING') THEN 'In avvio' ELSE 'Rigettato' END"""


@register("latest_run", f"""WITH {RUNS_SQL}
SELECT user_id, status, event_id AS last_event_id FROM runs
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_run(spark, sf):
    return S.latest_run(runs(spark, sf), "user_id", "ts", "event_id", keep=("event_id",)).select("user_id", "status", F.col("event_id").alias("last_event_id"))


@register("status_rollup", f"""WITH {RUNS_SQL}
SELECT user_id, day, {ROLLUP_CASE} AS group_status FROM runs GROUP BY user_id, day""")
def status_rollup(spark, sf):
    return S.status_rollup(runs(spark, sf), ["user_id", "day"])


@register("job_pipeline_status", f"""WITH {RUNS_SQL},
latest AS (SELECT day, user_id, status FROM runs
           QUALIFY row_number() OVER (PARTITION BY day, user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT day, 'user_' || CAST(user_id AS VARCHAR) AS name, status FROM latest
UNION ALL
SELECT day, 'GROUP' AS name, {ROLLUP_CASE} AS status FROM latest GROUP BY day""")
def job_pipeline_status(spark, sf):
    """Status of each pipeline (user) per day = its newest run; the day's group status rolls those up."""
    r = runs(spark, sf)
    latest = S.latest_run(r, ["day", "user_id"], "ts", "event_id")
    per = latest.select("day", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name"), "status")
    grp = S.status_rollup(latest, ["day"], out="status").select("day", F.lit("GROUP").alias("name"), "status")
    return per.unionByName(grp)


@register("stream_pipeline_status", f"""WITH {RUNS_SQL},
latest AS (SELECT day, user_id, status FROM runs
           QUALIFY row_number() OVER (PARTITION BY day, user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT day, CAST(user_id AS VARCHAR) AS name, status FROM latest
UNION ALL
SELECT day, 'GROUP' AS name, {ROLLUP_CASE} AS status FROM latest GROUP BY day""")
def stream_pipeline_status(spark, sf):
    """The same from a stream: run events arrive newest first, in three runs of the stream over one checkpoint."""
    from ..streaming import status as ST
    r = runs(spark, sf).select("day", "user_id", "status", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").cast("long").alias("run_id"))
    landing, root = STG.fresh(spark, "runs"), STG.fresh(spark, "status")
    table = ST.status_table(spark, root, {"day": "date", "user_id": r.schema["user_id"].dataType.simpleString()})
    for wave in (2, 1, 0):
        r.where(F.pmod(F.dayofyear("day"), F.lit(3)) == wave).write.mode("append").parquet(landing)
        ST.follow_status(spark.readStream.schema(r.schema).parquet(landing), table, f"{root}-checkpoint")
    return ST.pipeline_status(table, "user_id", ["day"])


@register("validate_range", f"""WITH {RUNS_SQL},
req AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE day END AS d_start,
        CASE WHEN event_type = 'view' AND value < 5 THEN NULL ELSE day + CAST(floor(value) - 10 AS INTEGER) END AS d_end FROM runs)
SELECT event_id, (d_start IS NOT NULL AND d_end IS NOT NULL AND d_end >= d_start) AS accepted,
       CASE WHEN d_start IS NULL OR d_end IS NULL THEN 'inserire data d''inizio e di fine'
            WHEN d_end < d_start THEN 'la data di inizio deve essere precedente alla data di fine' END AS reason
FROM req""")
def validate_range(spark, sf):
    r = runs(spark, sf)
    start = F.when(F.col("event_type") != "signup", F.col("day"))
    end = F.when(~((F.col("event_type") == "view") & (F.col("value") < 5)),
                 F.date_add("day", (F.floor("value") - 10).cast("int")))
    ok, reason = S.validate_range(start, end)
    return r.select("event_id", ok.alias("accepted"), reason.alias("reason"))


def _page_names(spark, sf):
    p = _t(spark, sf, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    path = F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1)
    suffix = F.when(host.endswith(".org"), F.lit(".csv")).when(host.endswith(".net"), F.lit(".xlsx")).otherwise(F.lit(""))
    return p.select("page_id", "url", F.concat(F.regexp_replace(path, "/", " "), suffix).alias("requested"))


PAGE_NAMES_SQL = """req AS (SELECT page_id, url,
   regexp_replace(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '/', ' ', 'g') ||
   CASE WHEN suffix(regexp_extract(url, '^https?://([^/]+)', 1), '.org') THEN '.csv'
        WHEN suffix(regexp_extract(url, '^https?://([^/]+)', 1), '.net') THEN '.xlsx' ELSE '' END AS requested FROM pages)"""


@register("share_name", f"""WITH {PAGE_NAMES_SQL},
n AS (SELECT page_id, replace(requested, ' ', '') AS nm FROM req)
SELECT page_id, CASE WHEN string_split(nm, '.')[-1] = 'csv' THEN nm
                     WHEN len(string_split(nm, '.')) < 2 THEN nm || '.csv' END AS file_name,
       (string_split(nm, '.')[-1] = 'csv' OR len(string_split(nm, '.')) < 2) AS accepted FROM n""")
def share_name(spark, sf):
    r = _page_names(spark, sf)
    name, ok = S.share_name(F.col("requested"))
    return r.select("page_id", name.alias("file_name"), ok.alias("accepted"))


@register("folder_route", """SELECT page_id,
  CASE WHEN contains(url, '.zip') OR contains(url, '.ZIP') THEN 'archive'
       WHEN contains(url, 'REP_ELE') THEN 'supply_points'
       WHEN contains(url, '15') AND contains(url, '.csv') THEN 'flow15'
       WHEN contains(url, 'gas') THEN 'gas_library' ELSE 'electricity_library' END AS route
FROM (SELECT page_id, regexp_replace(url, '\\.html$', '.csv') ||
             CASE WHEN contains(url, '?') THEN '.zip' ELSE '' END AS url FROM pages)""")
def folder_route(spark, sf):
    p = _t(spark, sf, "pages")
    name = F.concat(F.regexp_replace("url", r"\.html$", ".csv"), F.when(F.col("url").contains("?"), ".zip").otherwise(""))
    return p.select("page_id", LS.route(name).alias("route"))


EVENT_DAY_NAMES = "SELECT DISTINCT strftime(ts, '%Y%m%d') || 'MGPPrezzi.xml' AS name FROM events"


@register("date_range_files", f"""SELECT CAST(d AS DATE) AS day, strftime(d, '%Y%m%d') || 'MGPPrezzi.xml' AS name
FROM generate_series(DATE '2024-01-03', DATE '2024-01-20', INTERVAL 1 DAY) g(d)
WHERE strftime(d, '%Y%m%d') || 'MGPPrezzi.xml' IN ({EVENT_DAY_NAMES})""")
def date_range_files(spark, sf):
    e = _t(spark, sf, "events")
    listing = e.select(F.concat(F.date_format("ts", "yyyyMMdd"), F.lit(LS.PRICE_SUFFIX)).alias("name")).distinct()
    return LS.date_range_files(spark, "2024-01-03", "2024-01-20", listing)


@register("semi_listing", """SELECT DISTINCT strftime(ts, '%Y%m%d') AS name FROM events WHERE event_type = 'error'
  AND strftime(ts, '%Y%m%d') IN (SELECT strftime(ts, '%Y%m%d') FROM events WHERE event_type = 'purchase'
                                 AND value > 100)""")
def semi_listing_q(spark, sf):
    e = _t(spark, sf, "events")
    names = e.where(F.col("event_type") == "error").select(F.date_format("ts", "yyyyMMdd").alias("name")).distinct()
    listing = (e.where((F.col("event_type") == "purchase") & (F.col("value") > 100))
               .select(F.date_format("ts", "yyyyMMdd").alias("listed")))
    return semi_listing(names, listing, "name", "listed")


@register("max_date", "SELECT CAST(max(o_orderdate) AS DATE) AS max_date FROM orders")
def max_date(spark, sf):
    return _t(spark, sf, "orders").agg(F.to_date(F.max("o_orderdate")).alias("max_date"))


@register("filename_period_fixed", f"""SELECT COALESCE(CAST(substr(max(name), 24, 4) AS BIGINT), 0) AS Anno,
       COALESCE(CAST(substr(max(name), 28, 2) AS BIGINT), 0) AS Mese
FROM (SELECT 'RCU_' || CASE WHEN o_orderstatus = 'P' THEN 'REP_GAS_' ELSE 'REP_ELE_' END
             || {O.pad_left('CAST(o_orderkey AS VARCHAR)', '0', 11)} || strftime(o_orderdate, '%Y%m') || '.csv' AS name
      FROM orders) WHERE contains(name, 'REP_ELE')""")
def filename_period_fixed(spark, sf):
    from ..functions.text import pad_left
    o = _t(spark, sf, "orders")
    names = o.select(F.concat(F.lit("RCU_"), F.when(F.col("o_orderstatus") == "P", "REP_GAS_").otherwise("REP_ELE_"),
                              pad_left(F.col("o_orderkey").cast("string"), "0", 11),
                              F.date_format("o_orderdate", "yyyyMM"), F.lit(".csv")).alias("name"))
    return LS.period_of_batch(names)


@register("scan_table", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_table(spark, sf):
    """Whole table through the catalog (a session view stands in for the warehouse table)."""
    name = f"customer_{uuid.uuid4().hex[:8]}"
    _t(spark, sf, "customer").createOrReplaceTempView(name)
    return spark.table(name)


SCAN_SQL = """SELECT c_mktsegment, count(*) AS n_customers, min(c_acctbal) AS min_balance, max(c_acctbal) AS max_balance
FROM {customer} GROUP BY c_mktsegment"""


@register("scan_sql", SCAN_SQL.format(customer="customer"))
def scan_sql(spark, sf):
    """Arbitrary user SQL over registered views."""
    name = f"customer_{uuid.uuid4().hex[:8]}"
    _t(spark, sf, "customer").createOrReplaceTempView(name)
    return spark.sql(SCAN_SQL.format(customer=name))
