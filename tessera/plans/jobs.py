"""Ingest and export jobs: registry files, supply-point registers, XML prices,
offer libraries, generic CSV tables, flow-15 replace, export with padded identifiers, union of files.

Each job is a function over a landing folder (or a table) that returns the loaded DataFrame; the
``stage_*`` functions build landing folders from the driver tables for the checked queries, and
the ``*_SQL`` strings state the expected result in DuckDB.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.dates import filename_period_fixed, filename_period_next, parse_dayfirst
from ..functions.numbers import comma_decimal, round_3
from ..functions.text import pad_left, truncate_id
from ..operators.reshape import SUPPLY_POINT_RULES, apply_by_name_pattern, pad_id_columns, unpivot_zones
from ..session import arrow_fs, ship_package, small_methods
from ..sinks import tables as SK
from ..sinks.assemble import assemble_parts
from ..sources import archives as A
from ..sources import csv as CSV
from ..sources import listing as LS
from ..sources import preamble as P
from ..sources import xml as XML
from ..sources.ranges import range_lines
from . import fixtures as X
from . import oracle as O
from . import staging as S

LOAD_TS = "2024-11-25 06:30:00"


def union_files(spark: SparkSession, folders: list[str], sep: str = ";") -> DataFrame:
    """Each folder's files appended into one table by column name (UNION ALL over files)."""
    parts = [CSV.scan_csv_text(spark, f, sep=sep) for f in folders]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---- distributor registry (preamble files) ------------------------------------------------------

# Output layout of the registry table (52 columns).
MONTH_ORDER = ["06", "07", "08", "09", "10", "11", "12", "01", "02", "03", "04", "05"]
REGISTRY_COLUMNS = [
    "Anno", "Mese", "Piva_Distributore", "Ragione_Sociale_Distributore", "Zona", "POD", "CF", "PIVA",
    "Tipo_Misuratore", "Trattamento_m1", "Trattamento_m",
    "F1_06", "F2_06", "F3_06", "F1_07", "F2_07", "F3_07", "F1_08", "F2_08", "F3_08", "F1_09", "F2_09", "F3_09",
    "F1_10", "F2_10", "F3_10", "F1_11", "F2_11", "F3_11", "F1_12", "F2_12", "F3_12", "F1_01", "F2_01", "F3_01",
    "F1_02", "F2_02", "F3_02", "F1_03", "F2_03", "F3_03", "F1_04", "F2_04", "F3_04", "F1_05", "F2_05", "F3_05",
    "CONSUMO_TOT", "CONSUMO_F1", "CONSUMO_F2", "CONSUMO_F3", "DateUp",
]
REGISTRY_EXTRA = ["REGIME_COMPENSAZIONE", "DISALIMENTABILITA", "DATA_INIZIO_BONUS", "DATA_TERMINE_BONUS",
                  "MESE_RINNOVO", "ALTRE_COMUNICAZIONI"]
POD_LEN = 14


def registry_header_keys(titles: list[str]) -> list[str]:
    """A file's titles → canonical keys: positions 4 and 5 are the treatments, band/month titles
    become ``Fn_mm``; the rest keep their titles."""
    fixed = {4: "Trattamento_m1", 5: "Trattamento_m"}

    def key(i: int, t: str) -> str:
        band = next((b for b in ("F1", "F2", "F3") if b in t), None)
        return fixed.get(i) or (t if band is None or "CONSUMO" in t else f"{band}_{t[-2:]}")
    return [key(i, t) for i, t in enumerate(titles)]


def registry_import(spark: SparkSession, folder, load_ts: str = LOAD_TS, long_rows: str = "raise") -> DataFrame:
    """Registry files → 52-column table. Period = file month + 1 (from the ``YYYYMM`` name); the
    preamble gives company (first value), zone (second) and VAT (last). POD is cut to 14. Null tokens and
    empty cells are null; other text that is no number raises."""
    bands = [f"F{b}_{m}" for m in MONTH_ORDER for b in (1, 2, 3)]
    totals = ["CONSUMO_TOT", "CONSUMO_F1", "CONSUMO_F2", "CONSUMO_F3"]
    texts = ["POD", "CF", "PIVA", "Tipo_Misuratore", "Trattamento_m1", "Trattamento_m"]
    wanted = [*texts, *bands, *totals]
    rows = P.scan_preamble_rows(spark, folder, header_keys=registry_header_keys, long_rows=long_rows, wanted=wanted)
    cells = F.transform("values", lambda v: F.when(~v.isin(*CSV.DEFAULT_NULL_TOKENS), v))
    rows = rows.withColumn("cells", cells)
    f = {w: F.col("cells")[i] for i, w in enumerate(wanted)}
    anno, mese = filename_period_next(F.col("file_name"))
    cols = {
        "Anno": anno.cast("int"), "Mese": mese.cast("int"),
        "Piva_Distributore": F.col("vat"), "Ragione_Sociale_Distributore": F.col("company"), "Zona": F.col("zone"),
        "POD": truncate_id(f["POD"], POD_LEN), **{t: f[t] for t in texts[1:]},
        **{c: f[c].cast("double") for c in bands}, **{c: comma_decimal(f[c]) for c in totals},
        "DateUp": F.lit(load_ts).cast("timestamp_ntz"),
    }
    return rows.select(*[v.alias(k) for k, v in cols.items()])


EMPTY_CELL = (2, "09")  # band and month left empty for some customers


def _band_text(b: int, m: str) -> Column:
    return (F.col("c_acctbal").cast("decimal(12,2)") + F.lit(b * 100 + int(m))).cast("decimal(14,2)").cast("string")


def stage_registry_files(spark: SparkSession, sf_dir: str) -> str:
    """One registry file per nation and partition: preamble, header (month order differs between
    nations with even and odd keys), customer rows; the file month follows the nation key, so
    December files exist when there are at least 12 nations."""
    c = X.read_table(spark, sf_dir, "customer")
    n = X.read_table(spark, sf_dir, "nation")
    r = X.read_table(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    months_fwd = [(b, m) for m in MONTH_ORDER for b in (1, 2, 3)]
    months_rev = list(reversed(months_fwd))
    head_names = ["POD", "CF", "PIVA", "Tipo_Misuratore", "TRATT_MESE_PREC", "TRATT_MESE"]
    tail_names = ["CONSUMO_TOT", "CONSUMO_F1", "CONSUMO_F2", "CONSUMO_F3"] + REGISTRY_EXTRA

    def header(months):
        return ";".join(head_names + [f"ENERGIA_ATTIVA_F{b}_{m}" for b, m in months] + tail_names)

    def row(months):
        vals = [F.concat(F.lit("IT001E"), pad_left(F.col("c_custkey").cast("string"), "0", 9)),
                F.left(F.upper(F.md5(F.col("c_custkey").cast("string"))), F.lit(16)),
                pad_left(F.col("c_custkey").cast("string"), "0", 11),
                F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('; x"')), F.lit("MONORARIO"),
                F.when(F.col("c_acctbal") > 0, F.lit("ORARIO")).otherwise(F.lit("FASCE"))]
        # every seventh customer has an empty cell
        vals += [F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(_band_text(b, m)) if (b, m) == EMPTY_CELL else _band_text(b, m) for b, m in months]
        acct = F.col("c_acctbal").cast("decimal(12,2)")
        vals += [F.replace((acct * 3).cast("string"), F.lit("."), F.lit(","))]
        vals += [F.replace((acct + b).cast("decimal(14,2)").cast("string"), F.lit("."), F.lit(",")) for b in (1, 2, 3)]
        vals += [F.lit("N")] * len(REGISTRY_EXTRA)
        return F.concat_ws(";", *vals)

    odd = F.col("n_nationkey") % 2 == 1
    month = pad_left(((F.col("n_nationkey") % 12) + 1).cast("string"), "0", 2)
    pre = F.concat_ws(";", F.concat(F.lit("Distributore "), F.col("n_name")), F.col("r_name"), F.lit("-"),
                      pad_left(F.col("n_nationkey").cast("string"), "0", 11))
    staged = j.select(
        F.concat(F.lit("2024"), month, F.lit("_"), F.col("n_name")).alias("k"),
        F.concat(pre, F.lit("\n"), F.when(odd, F.lit(header(months_rev))).otherwise(F.lit(header(months_fwd)))).alias("h"),
        F.when(odd, row(months_rev)).otherwise(row(months_fwd)).alias("t"))
    dest = S.fresh(spark, "registry")
    S.write_text_files(staged, dest, "k", "h", "t")
    return dest


_REG_FROM = """FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""

REGISTRY_PREAMBLE_SQL = f"""SELECT 'IT001E' || {O.pad_left('CAST(c_custkey AS VARCHAR)', '0', 9)} AS POD,
       'Distributore ' || n_name AS company, r_name AS zone, {O.pad_left('CAST(n_nationkey AS VARCHAR)', '0', 11)} AS vat
{_REG_FROM}"""

REGISTRY_SQL = ("SELECT CAST(CASE WHEN n_nationkey % 12 = 11 THEN 2025 ELSE 2024 END AS BIGINT) AS Anno, "
                "CAST(CASE WHEN n_nationkey % 12 = 11 THEN 1 ELSE n_nationkey % 12 + 2 END AS BIGINT) AS Mese, "
                f"{O.pad_left('CAST(n_nationkey AS VARCHAR)', '0', 11)} AS Piva_Distributore, "
                "'Distributore ' || n_name AS Ragione_Sociale_Distributore, r_name AS Zona, "
                f"left('IT001E' || {O.pad_left('CAST(c_custkey AS VARCHAR)', '0', 9)}, 14) AS POD, "
                "left(upper(md5(CAST(c_custkey AS VARCHAR))), 16) AS CF, "
                f"{O.pad_left('CAST(c_custkey AS VARCHAR)', '0', 11)} AS PIVA, c_mktsegment || '; x' AS Tipo_Misuratore, "
                "'MONORARIO' AS Trattamento_m1, CASE WHEN c_acctbal > 0 THEN 'ORARIO' ELSE 'FASCE' END AS Trattamento_m, "
                + ", ".join(f"CAST({'CASE WHEN c_custkey % 7 <> 0 THEN ' if (b, m) == EMPTY_CELL else '('}CAST(CAST(c_acctbal AS DECIMAL(12,2)) + {b * 100 + int(m)} AS DECIMAL(14,2)){' END' if (b, m) == EMPTY_CELL else ')'} AS DOUBLE) AS F{b}_{m}"
                            for m in MONTH_ORDER for b in (1, 2, 3))
                + ", CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 3 AS DOUBLE) AS CONSUMO_TOT, "
                + ", ".join(f"CAST(CAST(CAST(c_acctbal AS DECIMAL(12,2)) + {b} AS DECIMAL(14,2)) AS DOUBLE) AS CONSUMO_F{b}"
                            for b in (1, 2, 3))
                + f", TIMESTAMP '{LOAD_TS}' AS DateUp " + _REG_FROM)


# ---- XML day-ahead prices -----------------------------------------------------------------------

# Zones of the staged price files (event types of the driver's events table).
ZONES = ["click", "error", "purchase", "signup", "view"]
PRICE_START, PRICE_END = "2024-01-03", "2024-01-20"


def stage_price_files(spark: SparkSession, sf_dir: str) -> str:
    """One XML file per day (``yyyymmddMGPPrezzi.xml``): rows per hour with one element per zone (decimal
    comma); a zone without events that hour is absent."""
    e = X.read_table(spark, sf_dir, "events")
    g = (e.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("h"))
         .pivot("event_type", ZONES).agg(F.sum(F.col("value").cast("decimal(12,2)"))))
    element = lambda tag, v: F.when(v.isNotNull(), F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>"))).otherwise("")
    day = F.date_format("day", "yyyyMMdd")
    cells = [element("Data", day), F.lit("<Mercato>MGP</Mercato>"), element("Ora", (F.col("h") + 1).cast("string")),
             *[element(z.upper(), F.replace(F.col(z).cast("string"), F.lit("."), F.lit(","))) for z in ZONES]]
    rows = g.select(day.alias("k"), F.lit("<NewDataSet>").alias("h"), F.concat(F.lit("<Prezzi>"), *cells, F.lit("</Prezzi>")).alias("t"))
    dest = S.fresh(spark, "prices")
    S.write_text_files(rows.repartition("k"), dest, "k", "h", "t", name_fmt="{key}" + LS.PRICE_SUFFIX, tail="</NewDataSet>")
    return dest


def price_import(spark: SparkSession, folder: str, start: str, end: str, load_ts: str = LOAD_TS) -> DataFrame:
    """Prices of the days ``start``..``end`` → long hourly table (Data, Ora, Zona, Prezzo, DateUp).

    The generated day names are joined to the folder's listing, and only those files (one a day of the
    range) are opened; columns come from them too. Days without a file are left out.
    """
    listing = LS.list_folder(spark, folder, "*" + LS.PRICE_SUFFIX)
    wanted = LS.day_names(spark, start, end)
    paths = sorted(r.path for r in listing.join(wanted.select("name"), "name", "left_semi").select("path").collect())
    if not paths:
        return spark.createDataFrame([], "Data date, Ora int, Zona string, Prezzo double, DateUp timestamp_ntz")
    long = unpivot_zones(XML.scan_xml_rows(spark, paths), ["Data", "Ora"], "Zona", "Prezzo")
    return long.select(F.to_date("Data", "yyyyMMdd").alias("Data"), F.col("Ora").cast("int").alias("Ora"),
                       F.col("Zona").cast("string").alias("Zona"), comma_decimal("Prezzo").alias("Prezzo"),
                       F.lit(load_ts).cast("timestamp_ntz").alias("DateUp"))


_PRICE_BASE = """FROM events GROUP BY CAST(ts AS DATE), hour(ts)"""

PRICE_ROWS_SQL = ("SELECT strftime(CAST(ts AS DATE), '%Y%m%d') AS Data, CAST(hour(ts) + 1 AS VARCHAR) AS Ora, "
                  + ", ".join(f"replace(CAST(SUM(CAST(value AS DECIMAL(12,2))) FILTER (WHERE event_type = '{z}') AS VARCHAR), '.', ',') AS {z.upper()}"
                              for z in ZONES) + " " + _PRICE_BASE)

PRICE_IMPORT_SQL = f"""SELECT CAST(ts AS DATE) AS Data, CAST(hour(ts) + 1 AS BIGINT) AS Ora, upper(event_type) AS Zona,
       CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS Prezzo, TIMESTAMP '{LOAD_TS}' AS DateUp
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{PRICE_START}' AND DATE '{PRICE_END}'
GROUP BY CAST(ts AS DATE), hour(ts), event_type"""


# ---- supply-point registers (zipped, Latin-1) ---------------------------------------------------

# Output layout of the supply-point table (73 columns).
SUPPLY_POINT_COLUMNS = [
    "Anno", "Mese", "COD_POD", "AREA_RIF", "RAGIONE_SOCIALE_DISTR", "PIVA_DISTR", "DP", "RAGIONE_SOCIALE_UDD",
    "PIVA_UDD", "RAGIONE_SOCIALE_CC", "PIVA_CC", "TIPO_MERCATO", "TIPO_POD", "FINE_TIPO_POD",
    "DATA_INIZIO_FORNITURA", "DATA_FINE_FORNITURA", "DATA_DECORRENZA_RET", "DATA_INIZIO_DISPACCIAMENTO", "CF",
    "PIVA", "CF_STRANIERO", "NOME", "COGNOME", "RAGIONE_SOCIALE_DENOMINAZIONE", "EMAIL_REFERENTE",
    "TELEFONO_CLIENTE", "EMAIL_CLIENTE", "RESIDENZA", "SERVIZIO_TUTELA", "SETT_MERCEOLOGICO", "COD_OFFERTA",
    "AUTOCERTIFICAZIONE", "CODICE_UFFICIO", "PAGAMENTO_IVA", "IVA", "IMPOSTE", "TENSIONE", "DISALIMENTABILITA",
    "TARIFFA_DISTRIBUZIONE", "TIPO_MISURATORE", "DATA_MESSA_REGIME", "MOTIVAZIONE", "POTCONTRIMP", "POTDISP",
    "CONSUMO", "TRATTAMENTO", "TRATTAMENTO_SUCC", "NUM_CIFRE_EA", "NUM_CIFRE_ER", "K_TRASFOR_ATT", "K_TRASFOR_REA",
    "K_TRASFOR_POT", "MAT_MISURATORE_ATT", "MAT_MISURATORE_REA", "MAT_MISURATORE_POT", "INST_MISURATOR_ATT",
    "INST_MISURATOR_REA", "INST_MISURATOR_POT", "NUM_CIFRE_ATT", "NUM_CIFRE_REA", "NUM_CIFRE_POT", "PRESENZA_MIS",
    "GEST_FORFAIT", "PMA", "REGIME_COMPENSAZIONE", "BF_DATA_INIZIO", "BF_DATA_FINE", "BF_DATA_RINNOVO",
    "BE_ANNO_VALIDITA", "BE_DATA_INIZIO", "BE_DATA_FINE", "BE_DATA_CESSAZIONE", "DateUp",
]
SUPPLY_POINT_PERIOD = "202411"


def supply_point_cast(df: DataFrame) -> DataFrame:
    """Register cleaning by column name (``reshape.SUPPLY_POINT_RULES``), FINE_TIPO_POD date, PMA rounded to 3."""
    df = apply_by_name_pattern(df, SUPPLY_POINT_RULES)
    return df.withColumns({"FINE_TIPO_POD": parse_dayfirst(F.col("FINE_TIPO_POD")), "PMA": round_3(F.col("PMA").cast("double"))})


def supply_point_import(spark: SparkSession, archive_folder: str, extract_to: str, load_ts: str = LOAD_TS,
                        long_rows: str = "drop") -> DataFrame:
    """Nested zips → extracted register files → 73-column table.

    One action extracts every member to shared storage (in the tasks, kept compressed) and finds the distinct header
    lines and the batch's period: that of the last ``REP_ELE`` name ((0, 0) without one). The register
    files are then read in one scan, each by its own header; rows with too many fields are dropped (or
    raise), short rows are null-padded.
    """
    small_methods(spark)
    name = F.element_at(F.split("member", "/"), -1)
    members = A.extract_archives(spark, archive_folder, extract_to, packed=True).where("size > 0")
    members = members.groupBy(F.decode("head", CSV.LATIN1).alias("head")).agg(F.count("*").alias("files"), F.max(F.when(name.contains(LS.SUPPLY_POINT_MARK), name)).alias("name"))
    heads = members.orderBy(F.desc("files"), "head").select("head", "name").collect()  # one row a distinct header
    last = spark.createDataFrame([(max((r.name for r in heads if r.name), default=None),)], "name string")
    y, m = filename_period_fixed(F.col("name"))
    batch = last.select(F.coalesce(y, F.lit(0)).alias("Anno"), F.coalesce(m, F.lit(0)).alias("Mese")).first()
    raw = CSV.scan_csv_text(spark, extract_to, sep=";", encoding=CSV.LATIN1, long_rows=long_rows, headers=[r.head for r in heads])
    raw = raw.withColumns({"COD_POD": truncate_id("COD_POD", POD_LEN), "Anno": F.lit(batch.Anno).cast("int"),
                           "Mese": F.lit(batch.Mese).cast("int"), "DateUp": F.lit(load_ts).cast("timestamp_ntz")})
    return supply_point_cast(raw.select(*SUPPLY_POINT_COLUMNS))


# Kind of text each column holds in the staged fixture (plain text where it is not listed).
SUPPLY_POINT_KINDS = {
    "period": (
        "Anno", "Mese",
    ),
    "pod": (
        "COD_POD",
    ),
    "id": (
        "PIVA_DISTR", "PIVA_UDD", "PIVA_CC", "CF", "PIVA", "TELEFONO_CLIENTE", "SETT_MERCEOLOGICO",
        "COD_OFFERTA", "MAT_MISURATORE_ATT", "MAT_MISURATORE_REA", "MAT_MISURATORE_POT",
    ),
    "date": (
        "FINE_TIPO_POD", "DATA_INIZIO_FORNITURA", "DATA_DECORRENZA_RET", "DATA_INIZIO_DISPACCIAMENTO",
        "DATA_MESSA_REGIME", "INST_MISURATOR_ATT", "INST_MISURATOR_REA", "INST_MISURATOR_POT", "BF_DATA_INIZIO",
        "BF_DATA_FINE", "BF_DATA_RINNOVO", "BE_DATA_INIZIO", "BE_DATA_FINE",
    ),
    "date_opt": (
        "DATA_FINE_FORNITURA",
    ),
    "email": (
        "EMAIL_CLIENTE",
    ),
    "accent": (
        "RESIDENZA",
    ),
    "nc": (
        "NUM_CIFRE_EA", "NUM_CIFRE_ER", "NUM_CIFRE_ATT", "NUM_CIFRE_REA", "NUM_CIFRE_POT",
    ),
    "k_x": (
        "K_TRASFOR_ATT",
    ),
    "k": (
        "K_TRASFOR_REA", "K_TRASFOR_POT",
    ),
    "pma": (
        "PMA",
    ),
    "date_last": (
        "BE_DATA_CESSAZIONE",
    ),
    "load": (
        "DateUp",
    ),
}
KIND_OF = {n: k for k, names in SUPPLY_POINT_KINDS.items() for n in names}
SUPPLY_POINT_LAYOUT = [(n, KIND_OF.get(n, "str")) for n in SUPPLY_POINT_COLUMNS]


def _sp_text(name: str, kind: str, i: int) -> Column:
    ln = F.col("l_linenumber")
    base = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), (ln + i).cast("string"))
    day = F.date_format(F.date_add(F.to_date("l_shipdate"), i), "dd/MM/yyyy")
    return {
        "pod": F.concat(F.lit("IT001E"), pad_left(F.col("l_orderkey").cast("string"), "0", 9)),
        "str": base,
        "id": pad_left((F.col("l_partkey") + i).cast("string"), "0", 11),
        "email": F.when(ln == 2, F.lit("")).otherwise(F.lit("cliente@example.org")),
        "accent": F.concat(F.lit("Città "), F.col("l_returnflag")),
        "date": day,
        "date_opt": F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(day),
        "date_last": day,
        "k": F.col("l_quantity").cast("int").cast("string"),
        "k_x": F.when(ln == 3, F.lit("x")).otherwise(F.col("l_quantity").cast("int").cast("string")),
        "nc": F.concat(ln.cast("string"), F.lit(".9")),
        "pma": F.col("l_extendedprice").cast("decimal(12,2)").cast("string"),
    }[kind]


def _sp_sql(name: str, kind: str, i: int) -> str:
    day = f"CAST(l_shipdate AS DATE) + {i}"
    return {
        "period": f"CAST({int(SUPPLY_POINT_PERIOD[:4]) if name == 'Anno' else int(SUPPLY_POINT_PERIOD[4:])} AS BIGINT)",
        "pod": f"left('IT001E' || {O.pad_left('CAST(l_orderkey AS VARCHAR)', '0', 9)}, 14)",
        "str": f"l_returnflag || l_linestatus || CAST(l_linenumber + {i} AS VARCHAR)",
        "id": O.pad_left(f"CAST(l_partkey + {i} AS VARCHAR)", "0", 11),
        "email": "CASE WHEN l_linenumber = 2 THEN NULL ELSE 'cliente@example.org' END",
        "accent": "'Città ' || l_returnflag",
        "date": day,
        "date_opt": f"CASE WHEN l_returnflag = 'N' THEN NULL ELSE {day} END",
        "date_last": f"CASE WHEN l_linenumber = 6 THEN NULL ELSE {day} END",
        "k": "CAST(CAST(l_quantity AS INTEGER) AS BIGINT)",
        "k_x": "CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS BIGINT) END",
        "nc": "CAST(l_linenumber AS BIGINT)",
        "pma": "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE)",
        "load": f"TIMESTAMP '{LOAD_TS}'",
    }[kind]


def stage_supply_point_archives(spark: SparkSession, sf_dir: str) -> str:
    """Register rows from lineitem in nested zips, in two column orders; line 7 rows carry extra fields, an
    empty one first in half of the files (dropped on load), line 6 rows lack the last register field, line 3 has ``x`` in K_TRASFOR_ATT."""
    small_methods(spark)
    li = X.read_table(spark, sf_dir, "lineitem")
    src = [(n, k, i) for i, (n, k) in enumerate(SUPPLY_POINT_LAYOUT) if k not in ("period", "load")]
    vals = [_sp_text(n, k, i) for n, k, i in src]
    ln = F.col("l_linenumber")
    line = (F.when(ln == 7, F.concat_ws(";", *vals, F.lit("EXTRA")))
            .when(ln == 6, F.concat_ws(";", *vals[:-1]))
            .otherwise(F.concat_ws(";", *vals)))
    header = ";".join(n for n, _, _ in src)
    # the registers of odd orders have their columns in reverse order
    back = [n for n, _, _ in reversed(src)]
    reverse = F.when(ln == 7, F.concat_ws(";", *reversed(vals), F.lit(""), F.lit("EXTRA"))).otherwise(F.concat_ws(";", F.when(ln == 6, F.lit("")).otherwise(vals[-1]), *reversed(vals[:-1])))
    dest = S.fresh(spark, "rcu-zips")
    name = "RCU_REP_ELE_" + "0" * 11 + SUPPLY_POINT_PERIOD + "_{tag}.csv"
    parts = spark.sparkContext.defaultParallelism
    odd = F.col("l_orderkey") % 2 == 1
    for rows, text, head, prefix in ((li.where(~odd), line, header, "RCU"), (li.where(odd), reverse, ";".join(back), "RCV")):
        # dealt out before the texts are built: a row of the table is a small part of its text
        A.write_archives(rows.repartition(parts).select(text.alias("t")), dest, "t", name, nested=True, header=head, archive_prefix=prefix)
    return dest


SUPPLY_POINT_SQL = ("SELECT " + ", ".join(f"{_sp_sql(n, k, i)} AS {n}" for i, (n, k) in enumerate(SUPPLY_POINT_LAYOUT))
                    + " FROM lineitem WHERE l_linenumber <> 7")


# ---- offer libraries -----------------------------------------------------------------------------

GAS_RANGE, ELECTRICITY_RANGE = "A:AA", "A:AX"
GAS_DATE_COLUMNS = ("Inizio_Validit__", "Fine_Validit__")


def offer_library(sheet: DataFrame, name: str) -> DataFrame:
    """Gas library (name contains ``gas``): first 27 columns, validity dates as ``MM/dd/yyyy``;
    otherwise electricity: first 50 columns unchanged."""
    if LS.GAS_MARK in name:
        t = N.sheet_columns(sheet, GAS_RANGE)
        return t.withColumns({c: F.date_format(F.to_date(F.col(c)), "MM/dd/yyyy") for c in GAS_DATE_COLUMNS})
    return N.sheet_columns(sheet, ELECTRICITY_RANGE)


def offer_libraries(spark: SparkSession, folder: str, gas_target: str, electricity_target: str, sep: str = ";",
                    as_table: bool = False) -> dict[str, int]:
    """Route every file of a folder by its name and replace the gas and the electricity table; files a table got.

    Sheets arrive as delimited files (or Parquet, by their suffix). Files of one kind and layout are one scan, and the layouts are appended
    by name; a kind without a file leaves its table as it is.
    """
    sheets = sheet_heads(spark, folder).groupBy("kind", "parquet", "head").agg(F.collect_list("path").alias("paths")).collect()  # one row a layout
    out = {}
    for kind, target in (("gas_library", gas_target), ("electricity_library", electricity_target)):
        own = sorted((r for r in sheets if r.kind == kind), key=lambda r: min(r.paths))
        read = [offer_library(spark.read.parquet(*sorted(r.paths)) if r.parquet else CSV.scan_csv_text(spark, sorted(r.paths), sep=sep, encoding="UTF-8", headers=[r.head]), kind) for r in own]
        if read:
            SK.sink_overwrite(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read), target, as_table=as_table)
        out[kind] = sum(len(r.paths) for r in own)
    return out


def sheet_heads(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, kind, parquet, head)`` of every sheet of a folder: its job by its name and its titles as one
    text (the first line, or the columns and types of a Parquet file), read by the tasks."""
    ship_package(spark)
    # a sheet is a delimited file, or a folder ending in .parquet; one row each
    sheet = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*?\.parquet)(/|$)", 1), F.lit("")), F.col("path"))
    files = LS.list_folder(spark, folder).select(sheet.alias("sheet"), "path").groupBy("sheet").agg(F.min("path").alias("file"))
    files = files.select("sheet", "file", LS.route(F.element_at(F.split("sheet", "/"), -1)).alias("kind"))

    def heads(batches):
        import pyarrow.parquet as pq
        for pdf in batches:
            out = []
            for sheet, file, kind in pdf.itertuples(index=False):
                fs, local = arrow_fs(file)
                parquet = sheet.endswith(".parquet")
                with fs.open_input_file(local) as f:
                    if parquet:
                        head = "\n".join(f"{x.name} {x.type}" for x in pq.read_schema(f))
                    else:
                        head = next((line.decode() for _, line in range_lines(f, 0, 1 << 62)), "")
                out.append((sheet, kind, parquet, head))
            yield pd.DataFrame(out, columns=["path", "kind", "parquet", "head"])

    return files.mapInPandas(heads, "path string, kind string, parquet boolean, head string")


def gas_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.read_table(spark, sf_dir, "orders")
    cols = [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority"),
            F.to_date("o_orderdate").alias("Inizio_Validit__"),
            F.date_add(F.to_date("o_orderdate"), 365).alias("Fine_Validit__")]
    cols += [F.concat(F.lit(f"v{i}_"), F.col("o_orderkey").cast("string")).alias(f"C{i:02d}") for i in range(7, 31)]
    return o.select(*cols)


def electricity_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.read_table(spark, sf_dir, "orders")
    cols = [F.concat(F.lit(f"e{i}_"), F.col("o_orderkey").cast("string")).alias(f"E{i:02d}") for i in range(2, 56)]
    return o.select("o_orderkey", *cols)


ELECTRICITY_LIBRARY_SQL = ("SELECT o_orderkey, " + ", ".join(f"'e{i}_' || CAST(o_orderkey AS VARCHAR) AS E{i:02d}" for i in range(2, 51)) + " FROM orders")

GAS_LIBRARY_SQL = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%m/%d/%Y') AS Inizio_Validit__, "
                   "strftime(CAST(o_orderdate AS DATE) + 365, '%m/%d/%Y') AS Fine_Validit__, "
                   + ", ".join(f"'v{i}_' || CAST(o_orderkey AS VARCHAR) AS C{i:02d}" for i in range(7, 28)) + " FROM orders")


# ---- generic CSV → new table, flow 15, export ---------------------------------------------------

def table_from_csv(spark: SparkSession, path: str, target: str, sep: str = ";", as_table: bool = False,
                   long_rows: str = "raise") -> tuple[DataFrame, tuple[bool, str]]:
    """Any CSV (Latin-1) → all-string table with cleaned headers, created only if absent."""
    df = N.sanitise_headers(CSV.scan_csv_text(spark, path, sep=sep, encoding=CSV.LATIN1, long_rows=long_rows))
    outcome = SK.sink_create_only(df, target, as_table=as_table)
    return df, outcome


FLOW15_MISSING = "file Acusim 15 non trovato"


def flow15_replace(spark: SparkSession, folder: str, target: str, as_table: bool = False, long_rows: str = "raise") -> str:
    """Replace the target table with the flow-15 files of the folder (name holds ``15`` and ``.csv``)."""
    listing = LS.list_folder(spark, folder)
    # names of the matching files only; their contents are read by the scan
    paths = [r.path for r in listing.where(LS.route(F.col("name")) == "flow15").select("path").collect()]
    if not paths:
        return FLOW15_MISSING
    SK.sink_overwrite(CSV.scan_csv_text(spark, paths, sep=";", encoding=CSV.LATIN1, long_rows=long_rows), target, as_table=as_table)
    return "loaded"


def share_export(spark: SparkSession, target: str, sql: str | None = None, table: str | None = None,
                 single_file: str | None = None) -> str:
    """Table or SQL result → identifiers of ``PDR`` columns zero-padded to 14 → ``;`` CSV with header.

    ``target`` receives the part files (each with the header). With ``single_file`` the parts are
    written without header and put into that one file behind a single header line, by the tasks.
    """
    df = pad_id_columns(spark.sql(sql) if sql else spark.table(table), "PDR", 14)
    if single_file is None:
        SK.sink_csv(df, target, sep=";", header=True, encoding="UTF-8")
        return target
    SK.sink_csv(df, target, sep=";", header=False, encoding="UTF-8")
    assemble_parts(spark, target, single_file, drop_final_newline=False, header=";".join(df.columns))
    return single_file
