"""Column functions against plain-Python statements of the same rules (randomized)."""

from decimal import Decimal

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.dates import parse_dayfirst
from tessera.functions.numbers import to_int_floor

from tessera.functions import names as N
from tessera.functions import numbers as M
from tessera.functions import text as T
from tessera.operators import status as S


def py_pad_left(s, fill, n):
    return fill * (n - len(s)) + s if len(s) < n else s


def py_pad_right(s, fill, n):
    return s + fill * (n - len(s)) if len(s) < n else s


def py_cents(x: Decimal) -> str:
    q = x.quantize(Decimal("0.01"), rounding="ROUND_HALF_EVEN")
    return py_pad_left(str(abs(q)).replace(".", ""), "0", 3) if abs(q) >= 1 else py_pad_left(
        str(int(abs(q) * 100)), "0", 3)


texts = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=30)


@settings(max_examples=25, deadline=None)
@given(st.lists(texts, min_size=1, max_size=20), st.integers(min_value=0, max_value=25))
def test_pads_never_truncate(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select(T.pad_left("s", "0", n).alias("l"), T.pad_right("s", " ", n).alias("r")).collect()
    assert [g.l for g in got] == [py_pad_left(v, "0", n) for v in values]
    assert [g.r for g in got] == [py_pad_right(v, " ", n) for v in values]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.decimals(min_value=-9999, max_value=9999, places=3, allow_nan=False), min_size=1, max_size=20))
def test_amount_cents(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x decimal(18,3)")
    got = [r.c for r in df.select(M.amount_cents("x").alias("c")).collect()]
    assert got == [py_cents(v) for v in values]


def test_amount_cents_examples(spark):
    df = spark.createDataFrame([(Decimal("-12.50"),), (Decimal("0.05"),), (Decimal("0"),), (Decimal("-0.125"),)],
                               "x decimal(18,3)")
    assert [r.c for r in df.select(M.amount_cents("x").alias("c")).collect()] == ["1250", "005", "000", "012"]


def test_fold_name(spark):
    df = spark.createDataFrame([("perù Òmar",), (None,), ("À" * 95,), ("élan",)], "s string")
    got = [r.f for r in df.select(T.fold_name(F.col("s"), F.lit("FALLBACK")).alias("f")).collect()]
    assert got[0] == "PERU' O'MAR"
    assert got[1] == "FALLBACK"
    assert got[2] == "A'" * 90 and len(got[2]) == 180  # cut at 90, then folded: may exceed 90
    assert got[3] == "ÉLAN"  # É is not folded


def test_letter_o_to_zero(spark):
    df = spark.createDataFrame([("foo",), ("FOO",), ("FoO",), (None,), ("x",)], "s string")
    assert [r.z for r in df.select(T.letter_o_to_zero("s").alias("z")).collect()] == ["f00", "F00", "F0O", None, "x"]


def test_to_int_floor_matches_pandas(spark):
    vals = ["7.9", "x", None, "-1.5", "12", "", "1e3"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.v for r in df.select(M.to_int_floor("s").alias("v")).collect()]
    import numpy as np
    want = np.floor(pd.to_numeric(pd.Series(vals), errors="coerce")).astype("Int64").tolist()
    assert got == [None if pd.isna(w) else int(w) for w in want]


def test_round_half_even(spark):
    df = spark.createDataFrame([(Decimal("0.125"),), (Decimal("0.135"),), (Decimal("-2.675"),)], "x decimal(18,3)")
    assert [r.r for r in df.select(M.round_2("x").alias("r")).collect()] == [Decimal("0.12"), Decimal("0.14"),
                                                                           Decimal("-2.68")]


def test_sanitise_and_band_names():
    assert N.sanitise_name("Cod. Cliente (n°)") == "Cod_Cliente_n"
    assert N.sanitise_name("Città/Perché?") == "Citt" + "Perch"
    assert N.sanitise_name("È maiuscola") == "È_maiuscola"  # upper-case accents stay
    assert N.band_month_name("ENERGIA_F2_MESE_11") == "F2_11"
    assert N.band_month_name("CONSUMO_F1") == "CONSUMO_F1"
    assert N.excel_columns("A:AA") == (0, 27) and N.excel_columns("A:AX") == (0, 50)


def test_share_name(spark):
    df = spark.createDataFrame([("rep ort.csv",), ("report",), ("rep.xlsx",), ("a.b.csv",)], "s string")
    name, ok = S.share_name(F.col("s"))
    got = [(r.n, r.ok) for r in df.select(name.alias("n"), ok.alias("ok")).collect()]
    assert got == [("report.csv", True), ("report.csv", True), (None, False), ("a.b.csv", True)]


def test_status_rollup(spark):
    df = spark.createDataFrame([("g1", "COMPLETED"), ("g1", "PENDING"), ("g2", "COMPLETED"), ("g2", "REJECTED"),
                                ("g2", "RUNNING"), ("g3", "REJECTED")], "g string, status string")
    got = {r.g: r.group_status for r in S.status_rollup(df, ["g"]).collect()}
    assert got == {"g1": "In esecuzione", "g2": "In avvio", "g3": "Rigettato"}


def test_validate_range(spark):
    df = spark.sql("SELECT DATE'2024-01-02' a, DATE'2024-01-01' b UNION ALL SELECT DATE'2024-01-01', DATE'2024-01-01' "
                   "UNION ALL SELECT NULL, DATE'2024-01-01'")
    ok, reason = S.validate_range(F.col("a"), F.col("b"))
    got = [r.ok for r in df.select(ok.alias("ok")).collect()]
    assert got == [False, True, False]


codes = st.sampled_from(["cl1", "CL1", "Cl2", "cl3", None])
amounts = st.one_of(st.none(), st.decimals(min_value=-100, max_value=7000, places=2, allow_nan=False))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(codes, amounts), min_size=1, max_size=25))
def test_credits_by_code_matches_pandas(spark, rows):
    from tessera.operators.ledger import credits_by_code
    df = spark.createDataFrame(rows, "Codice_Cliente string, Avere decimal(18,2)")
    got = {r.Codice_Cliente: r.Avere for r in credits_by_code(df).collect()}
    pdf = pd.DataFrame(rows, columns=["Codice Cliente", "Avere"])
    pdf["Codice Cliente"] = pdf["Codice Cliente"].str.upper()
    want = pdf.groupby("Codice Cliente").agg(Avere=("Avere", "sum")).reset_index()
    assert got == {k: Decimal(str(v)).quantize(Decimal("0.01")) for k, v in zip(want["Codice Cliente"], want["Avere"])}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False)),
                          st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False))), min_size=1, max_size=15))
def test_unpivot_matches_melt(spark, rows):
    from tessera.operators.reshape import unpivot_zones
    rows = [(i, h, a, b) for i, (h, a, b) in enumerate(rows)]
    df = spark.createDataFrame(rows, "Data long, Ora long, NORD double, SUD double")
    got = sorted((r.Data, r.Ora, r.Zona, r.Prezzo) for r in unpivot_zones(df, ["Data", "Ora"]).collect())
    pdf = pd.DataFrame(rows, columns=["Data", "Ora", "NORD", "SUD"])
    melt = pd.melt(pdf, id_vars=["Data", "Ora"], value_vars=["NORD", "SUD"], var_name="Zona",
                   value_name="Prezzo").dropna(axis=0, how="any")
    want = sorted((int(a), int(b), c, float(d)) for a, b, c, d in melt.itertuples(index=False))
    assert got == want


def test_lenient_integers_like_pandas(spark):
    values = ["3", "3.9", " 4 ", "-2.5", "1e3", "3d", "2F", "NaN", "Infinity", "-Infinity", "x", "", None, "1e30", ".5", "5."]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.k for r in df.select("i", to_int_floor("v").alias("k")).collect()}
    assert [got[i] for i in range(len(values))] == [3, 3, 4, -3, 1000] + [None] * 8 + [None, 0, 5]


def test_dayfirst_chain_is_tried_once(spark):
    df = spark.createDataFrame([("05/01/2024",), ("2024-01-05",), (" ",), (None,)], "v string")
    assert [str(r.d) for r in df.select(parse_dayfirst("v").alias("d")).collect()] == ["2024-01-05", "2024-01-05", "None", "None"]
    plan = df.select(parse_dayfirst("v").alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("dd.MM.yyyy") == 1
    with pytest.raises(Exception, match="unparseable"):
        spark.createDataFrame([("soon",)], "v string").select(parse_dayfirst("v").alias("d")).collect()
