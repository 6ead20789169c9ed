"""Checked queries for scalar functions (§2.9) and projections (§2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import dates as D
from ..functions import names as N
from ..functions import numbers as M
from ..functions import text as T
from ..operators import reshape as RS
from . import fixtures as X
from . import oracle as O
from .registry import register

W = O.with_ledger
RUN_ID = X.RUN_ID


def _t(spark, sf, name):
    return X.read_table(spark, sf, name)


# ---- text ----------------------------------------------------------------------------------------

@register("pad_left", f"SELECT p_partkey, {O.pad_left('p_name', '.', 12)} AS padded FROM part")
def pad_left(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.pad_left("p_name", ".", 12).alias("padded"))


@register("pad_right", f"SELECT p_partkey, {O.pad_right('p_name', '.', 12)} AS padded FROM part")
def pad_right(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.pad_right("p_name", ".", 12).alias("padded"))


@register("pad_id_14", f"""SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL
       ELSE {O.pad_left('CAST(o_orderkey AS VARCHAR)', '0', 14)} END AS PDR_fornitura FROM orders""")
def pad_id_14(spark, sf):
    o = _t(spark, sf, "orders")
    t = o.select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("PDR_fornitura"))
    return RS.pad_id_columns(t, "PDR", 14)


@register("spaces", "SELECT p_partkey, p_brand || '    ' || p_type AS label FROM part")
def spaces_q(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.concat("p_brand", T.spaces(4), "p_type").alias("label"))


@register("truncate_id_14", "SELECT p_partkey, left(p_name || p_brand, 14) AS POD FROM part")
def truncate_id_14(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.truncate_id(F.concat("p_name", "p_brand"), 14).alias("POD"))


@register("fold_name", f"SELECT doc_id, {O.fold('text')} AS Denominazione FROM documents")
def fold_name(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.fold_name("text").alias("Denominazione"))


@register("coalesce_id", W("SELECT No, COALESCE(FiscalCode, VATRegistrationNo) AS CF_PIVA FROM c_customer"))
def coalesce_id(spark, sf):
    c = X.customers(spark, sf)
    return c.select("No", T.coalesce_id("FiscalCode", "VATRegistrationNo").alias("CF_PIVA"))


@register("upper_code", "SELECT c_custkey, upper(lower(c_name)) AS code FROM customer")
def upper_code(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", T.upper_code(F.lower("c_name")).alias("code"))


@register("letter_o_to_zero", """SELECT p_partkey,
       CASE WHEN contains(p_name, 'o') THEN replace(p_name, 'o', '0')
            WHEN contains(p_name, 'O') THEN replace(p_name, 'O', '0') ELSE p_name END AS lower_form,
       CASE WHEN contains(upper(p_name), 'o') THEN replace(upper(p_name), 'o', '0')
            WHEN contains(upper(p_name), 'O') THEN replace(upper(p_name), 'O', '0') ELSE upper(p_name) END AS upper_form
       FROM part""")
def letter_o_to_zero(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", T.letter_o_to_zero("p_name").alias("lower_form"),
                    T.letter_o_to_zero(F.upper("p_name")).alias("upper_form"))


# ---- numbers -------------------------------------------------------------------------------------

@register("amount_cents", W(f"SELECT CustLedgerEntryNo, {O.cents('Amount')} AS cents FROM dcle_detail"))
def amount_cents(spark, sf):
    d = X.details(spark, sf)
    return d.select("CustLedgerEntryNo", M.amount_cents("Amount").alias("cents"))


@register("comma_decimal", """SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price FROM part""")
def comma_decimal(spark, sf):
    p = _t(spark, sf, "part")
    text = F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    return p.select("p_partkey", M.comma_decimal(text).alias("price"))


@register("to_int_floor", """SELECT event_id,
       CAST(floor(TRY_CAST(regexp_extract(props, ':\\s*([^}]*)', 1) AS DOUBLE)) AS BIGINT) AS k,
       CAST(floor(value) AS BIGINT) AS value_floor,
       CAST(floor(TRY_CAST(event_type AS DOUBLE)) AS BIGINT) AS kind_num FROM events""")
def to_int_floor(spark, sf):
    e = _t(spark, sf, "events")
    k_text = F.regexp_extract("props", r":\s*([^}]*)", 1)
    return e.select("event_id", M.to_int_floor(k_text).alias("k"), M.to_int_floor("value").alias("value_floor"),
                    M.to_int_floor("event_type").alias("kind_num"))


@register("round_2", W("SELECT CustLedgerEntryNo, CAST(round_even(Amount * CAST(0.125 AS DECIMAL(4,3)), 2) AS DOUBLE) AS r2 FROM dcle_detail"))
def round_2(spark, sf):
    d = X.details(spark, sf)
    return d.select("CustLedgerEntryNo", M.round_2(F.col("Amount") * F.lit(0.125).cast("decimal(4,3)")).alias("r2"))


@register("round_3", W("SELECT CustLedgerEntryNo, CAST(round_even(Amount * CAST(0.0625 AS DECIMAL(5,4)), 3) AS DOUBLE) AS r3 FROM dcle_detail"))
def round_3(spark, sf):
    d = X.details(spark, sf)
    return d.select("CustLedgerEntryNo", M.round_3(F.col("Amount") * F.lit(0.0625).cast("decimal(5,4)")).alias("r3"))


# ---- dates ---------------------------------------------------------------------------------------

@register("parse_dayfirst", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def parse_dayfirst(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", D.parse_dayfirst(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"))


@register("format_us_date", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us_date FROM orders")
def format_us_date(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", D.format_us_date("o_orderdate").alias("us_date"))


@register("parse_compact_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def parse_compact_date(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", D.parse_compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("d"))


@register("date_stamp", """SELECT o_orderkey, strftime(o_orderdate, '%d%m%y') AS ddmmyy, strftime(o_orderdate, '%y%m%d') AS yymmdd,
       strftime(o_orderdate, '%Y%m%d') AS yyyymmdd FROM orders""")
def date_stamp(spark, sf):
    o = _t(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    return o.select("o_orderkey", D.date_stamp(d, "ddMMyy").alias("ddmmyy"), D.date_stamp(d, "yyMMdd").alias("yymmdd"),
                    D.date_stamp(d, "yyyyMMdd").alias("yyyymmdd"))


@register("filename_period_next", """SELECT o_orderkey, CAST(year(o_orderdate + INTERVAL 1 MONTH) AS BIGINT) AS Anno,
       CAST(month(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS BIGINT) AS Mese FROM orders""")
def filename_period_next(spark, sf):
    o = _t(spark, sf, "orders")
    name = F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("_ANAGRAFICHE_"), F.col("o_orderkey").cast("string"),
                    F.lit(".csv"))
    y, m = D.filename_period_next(name)
    return o.select("o_orderkey", y.alias("Anno"), m.alias("Mese"))


# ---- codes ---------------------------------------------------------------------------------------

@register("numeric_code", W(f"SELECT No, {O.digits('No', 9)} AS code FROM c_customer"))
def numeric_code(spark, sf):
    return X.customers(spark, sf).select("No", C.numeric_code(RUN_ID, "No", 9).alias("code"))


@register("alnum_code", W(f"SELECT No, {O.alnum('No', 20)} AS code FROM c_customer"))
def alnum_code(spark, sf):
    return X.customers(spark, sf).select("No", C.alnum_code(RUN_ID, "No", 20).alias("code"))


@register("unique_key_30", W(f"SELECT No, No || '00' || {O.alnum('No', 20)} AS CodiceUnivoco FROM c_customer"))
def unique_key_30(spark, sf):
    return X.customers(spark, sf).select("No", C.unique_key_30(RUN_ID, "No").alias("CodiceUnivoco"))


# ---- projections ---------------------------------------------------------------------------------

FIXED = ["l_linenumber", "l_orderkey", "l_returnflag", "l_quantity", "l_shipdate"]


@register("project_fixed", "SELECT l_linenumber, l_orderkey, l_returnflag, l_quantity, l_shipdate FROM lineitem",
          bigint=("l_linenumber",))
def project_fixed(spark, sf):
    return N.project_fixed(_t(spark, sf, "lineitem"), FIXED)


@register("rename_positional", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS Trattamento_m1,
       l_extendedprice AS Trattamento_m, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""",
          bigint=("l_linenumber",))
def rename_positional(spark, sf):
    return N.rename_positional(_t(spark, sf, "lineitem"))


MONTHS = ["06", "07", "08", "09", "10", "11", "12", "01", "02", "03", "04", "05"]


def _band_value(band: int, month: str):
    return (F.col("c_acctbal").cast("decimal(12,2)") + F.lit(band * 100 + int(month))).cast("decimal(14,2)")


def _band_sql(band: int, month: str) -> str:
    return f"CAST(CAST(c_acctbal AS DECIMAL(12,2)) + {band * 100 + int(month)} AS DECIMAL(14,2))"


@register("rename_pattern", "SELECT c_custkey, " + ", ".join(
    f"CAST({_band_sql(b, m)} AS DOUBLE) AS F{b}_{m}" for m in MONTHS for b in (1, 2, 3))
    + ", CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS CONSUMO_F1 FROM customer")
def rename_pattern(spark, sf):
    c = _t(spark, sf, "customer")
    cols = [F.col("c_custkey")]
    for m in MONTHS:
        for b in (1, 2, 3):
            cols.append(_band_value(b, m).alias(f"ENERGIA ATTIVA F{b} MESE {m}"))
    cols.append(F.col("c_acctbal").cast("decimal(12,2)").alias("CONSUMO_F1"))
    return N.rename_pattern(c.select(*cols))


MESSY = {"c_custkey": "Cod. Cliente", "c_name": "Ragione Sociale (Nome)", "c_nationkey": "Nazione/Paese",
         "c_acctbal": "Saldo [€] +/-", "c_mktsegment": "Settore #1 ° «più»"}


@register("sanitise_headers", """SELECT c_custkey AS "Cod_Cliente", c_name AS "Ragione_Sociale_Nome",
       CAST(c_nationkey AS BIGINT) AS "NazionePaese", c_acctbal AS "Saldo_€_-", c_mktsegment AS "Settore_1__«pi»" FROM customer""")
def sanitise_headers(spark, sf):
    c = _t(spark, sf, "customer")
    return N.sanitise_headers(c.select(*[F.col(k).alias(v) for k, v in MESSY.items()]))


@register("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def drop_columns(spark, sf):
    return _t(spark, sf, "orders").drop("o_totalprice", "o_orderpriority")


@register("with_constants", """SELECT l_orderkey, l_linenumber, CAST(2024 AS BIGINT) AS Anno, CAST(12 AS BIGINT) AS Mese,
       'NORD' AS Zona, 'Distributore Uno' AS Ragione_Sociale_Distributore, '01234567890' AS Piva_Distributore FROM lineitem""",
          bigint=("l_linenumber",))
def with_constants(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return RS.with_constants(li, {"Anno": 2024, "Mese": 12, "Zona": "NORD",
                                  "Ragione_Sociale_Distributore": "Distributore Uno",
                                  "Piva_Distributore": "01234567890"})


LOAD_TS = "2024-11-25 06:30:00"


@register("with_load_time", f"SELECT o_orderkey, o_orderstatus, TIMESTAMP '{LOAD_TS}' AS DateUp FROM orders")
def with_load_time(spark, sf):
    return RS.with_load_time(_t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), LOAD_TS)


@register("sheet_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem",
          bigint=("l_linenumber",))
def sheet_columns(spark, sf):
    return N.sheet_columns(_t(spark, sf, "lineitem"), "A:F")


def register_like(li):
    """Supply-point-register-shaped text columns derived from lineitem."""
    return li.select(
        "l_orderkey", "l_linenumber",
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("DATA_SPEDIZIONE"),
        F.date_format("l_shipdate", "d/M/yyyy").alias("INST_MISURATOR_ATT"),
        F.when(F.col("l_linenumber") == 3, F.lit("x")).otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("K_TRASFOR_ATT"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(".9")).alias("NUM_CIFRE_EA"),
        F.replace(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")).alias("CONSUMO"),
        F.col("l_orderkey").cast("string").alias("PDR_CODICE"),
        F.col("l_returnflag").alias("TIPO_POD"))


@register("apply_by_name_pattern", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_shipdate AS DATE) AS DATA_SPEDIZIONE, CAST(l_shipdate AS DATE) AS INST_MISURATOR_ATT,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS BIGINT) END AS K_TRASFOR_ATT,
       CAST(l_linenumber AS BIGINT) AS NUM_CIFRE_EA,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS CONSUMO,
       {O.pad_left('CAST(l_orderkey AS VARCHAR)', '0', 14)} AS PDR_CODICE, l_returnflag AS TIPO_POD FROM lineitem""")
def apply_by_name_pattern(spark, sf):
    return RS.apply_by_name_pattern(register_like(_t(spark, sf, "lineitem")))


def measures(li):
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"),
                     F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("l_tax"))


MEASURES_SQL = """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, NULLIF(l_discount, 0) AS l_discount,
       NULLIF(l_tax, 0) AS l_tax FROM lineitem"""


@register("unpivot_zones", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, Zona, Prezzo
       FROM ({MEASURES_SQL}) m UNPIVOT (Prezzo FOR Zona IN (l_quantity, l_extendedprice, l_discount, l_tax))""")
def unpivot_zones(spark, sf):
    return RS.unpivot_zones(measures(_t(spark, sf, "lineitem")), ["l_orderkey", "l_linenumber"])


@register("filter_dropna_any", f"SELECT * FROM ({MEASURES_SQL}) m WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL",
          bigint=("l_linenumber",))
def filter_dropna_any(spark, sf):
    return measures(_t(spark, sf, "lineitem")).dropna(how="any")
