"""Layout properties of the payment files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.operators.numbering import number_dense, number_window_oracle
from tessera.sinks import fixed_width as FW


def cands(spark, rows):
    return spark.createDataFrame(rows, "Cliente string, SaldoCliente decimal(18,2), CF string, Denominazione string")


P = R.FileParams("domiciled", "2024-11-25", "run-x", "Servizi Energia S.p.A. Benefit")
PO = R.FileParams("ordinary", "2024-11-25", "run-x")


def lines_of(spark, rows, params=P):
    n = number_dense(cands(spark, rows), ["Cliente"], out="nr")
    return R.payment_lines(n, params, nr="nr", amount="SaldoCliente", tax_id="CF", name="Denominazione",
                           key="Cliente").orderBy("seq", "sub").collect()


ROWS = [("CL000001", -12.5, "A" * 16, "ROSSI MARIO"), ("CL000002", -0.05, "B" * 16, "VERDI"),
        ("CL000003", -5999.99, "C" * 16, "X" * 95)]


def test_line_count_and_lengths(spark):
    from decimal import Decimal
    rows = [(a, Decimal(str(b)), c, d) for a, b, c, d in ROWS]
    out = lines_of(spark, rows)
    assert len(out) == 7 * len(rows) + 2
    for r in out:
        if r.sub == 3 and r.seq == 3:
            assert len(r.line) == 120 + 5  # a 95-character name is kept whole
        else:
            assert len(r.line) == 120, (r.seq, r.sub, r.line)
    body = [r for r in out if r.sub > 0]
    assert sorted({r.seq for r in body}) == [1, 2, 3]
    tail = out[-1].line
    assert tail[45:52] == "0000003"
    assert tail[67:82] == str(1250 + 5 + 599999).zfill(15)
    assert tail[82:89] == "0000023"


def test_amount_field_and_keys(spark):
    from decimal import Decimal
    rows = [(a, Decimal(str(b)), c, d) for a, b, c, d in ROWS]
    out = lines_of(spark, rows)
    r10 = [r.line for r in out if r.sub == 1]
    assert r10[0][33:46] == "0000000001250"
    assert r10[1][33:46] == "0000000000005"
    keys = [r.line[56:86] for r in out if r.sub == 7]
    assert [k[:8] for k in keys] == ["CL000001", "CL000002", "CL000003"]
    assert all(k[8:10] == "00" and len(k) == 30 for k in keys)


def test_empty_file(spark):
    out = lines_of(spark, [])
    assert len(out) == 2
    assert out[1].line[45:52] == "0000000" and out[1].line[82:89] == "0000002"
    assert out[1].line[67:82] == "0" * 15


def test_ordinary_lengths(spark):
    from decimal import Decimal
    df = spark.createDataFrame([("1", Decimal("-20.00"), "CL1", "CF1234567890ABCD")],
                               "Fornitura string, SaldoFornitura decimal(18,2), Cliente string, CF string")
    n = number_dense(df, ["Cliente", "Fornitura"], out="nr")
    out = R.payment_lines(n, PO, nr="nr", amount="SaldoFornitura", tax_id="CF", name=None,
                          key="Fornitura").orderBy("seq", "sub").collect()
    lens = [len(r.line) for r in out]
    assert lens == [120, 103, 120, 120, 120, 116, 116, 120, 120]


def test_vat_line_is_115(spark):
    from decimal import Decimal
    out = lines_of(spark, [("CL000009", Decimal("-20"), "01234567890", "ACME")])
    assert len([r for r in out if r.sub == 1][0].line) == 115


def test_ordered_write_and_scan_back(spark, tmp_dir):
    from decimal import Decimal
    rows = [(f"CL{i:06d}", Decimal("-15.00"), "D" * 16, f"NOME {i}") for i in range(1, 400)]
    n = number_dense(cands(spark, rows).repartition(7), ["Cliente"], out="nr")
    lines = R.payment_lines(n, P, nr="nr", amount="SaldoCliente", tax_id="CF", name="Denominazione", key="Cliente")
    dest = os.path.join(tmp_dir, "file")
    FW.sink_fixed_width(lines, dest, partitions=5)
    merged = os.path.join(tmp_dir, "bonifici.txt")
    FW.merge_parts(dest, merged)
    text = open(merged).read()
    assert not text.endswith("\n")
    got = text.split("\n")
    want = [r.line for r in lines.orderBy("seq", "sub").collect()]
    assert got == want
    keys = [r.CodiceUnivoco for r in FW.scan_fixed_width(spark, dest).collect()]
    assert sorted(k[:8] for k in keys) == [f"CL{i:06d}" for i in range(1, 400)]


def test_dense_numbering_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 37).alias("c"), F.col("id").alias("t")).repartition(9)
    got = number_dense(df, ["c", "t"]).select("c", "t", "nr").orderBy("nr").collect()
    want = number_window_oracle(df, ["c", "t"]).select("c", "t", "nr").orderBy("nr").collect()
    assert got == want
    assert [r.nr for r in got] == list(range(1, 5001))


def test_dense_numbering_hot_key_spreads(spark):
    # a third of the rows share one customer; the tie-breaker spreads them over several partitions
    df = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("c"),
                                     F.col("id").alias("t"))
    # small data: make AQE keep several range partitions, as large data would
    confs = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        out = number_dense(df, ["c", "t"])
        per_part = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(per_part) > 1 and max(r["count"] for r in per_part) < 9000 / 2
        assert out.agg(F.countDistinct("nr"), F.min("nr"), F.max("nr")).first() == (9000, 1, 9000)
        w = number_window_oracle(df, ["c", "t"])
        assert out.select("c", "t", "nr").exceptAll(w.select("c", "t", "nr")).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_merge_latin1_keeps_byte_width(spark, tmp_dir):
    from decimal import Decimal
    rows = [("CL000001", Decimal("-15.00"), "D" * 16, "ÉLAN PERÙ")]
    n = number_dense(cands(spark, rows), ["Cliente"], out="nr")
    lines = R.payment_lines(n, P, nr="nr", amount="SaldoCliente", tax_id="CF", name="Denominazione", key="Cliente")
    FW.sink_fixed_width(lines, os.path.join(tmp_dir, "f"), partitions=2)
    FW.merge_parts(os.path.join(tmp_dir, "f"), os.path.join(tmp_dir, "b.txt"), encoding="latin-1")
    raw = open(os.path.join(tmp_dir, "b.txt"), "rb").read()
    recs = raw.split(b"\n")
    assert len(recs) == 9 and all(len(r) == 120 for r in recs)
    assert "ÉLAN PERÙ".encode("latin-1") in raw


def test_part_files_in_the_order_of_their_numbers(tmp_dir):
    for n in (9999, 10000, 99999, 100000, 100001):
        with open(os.path.join(tmp_dir, f"part-{n:05d}-x.txt"), "w") as fh:
            fh.write(f"{n}\n")
    FW.merge_parts(tmp_dir, os.path.join(tmp_dir, "all.txt"))
    assert open(os.path.join(tmp_dir, "all.txt")).read().split() == ["9999", "10000", "99999", "100000", "100001"]


def test_blocks_are_shuffled_whole_and_parts_follow_the_data(spark, tmp_dir):
    from decimal import Decimal
    rows = [(f"CL{i:06d}", Decimal("-15.00"), "D" * 16, f"NOME {i}") for i in range(1, 200)]
    n = number_dense(cands(spark, rows), ["Cliente"], out="nr")
    blocks = R.payment_blocks(n, P, nr="nr", amount="SaldoCliente", tax_id="CF", name="Denominazione", key="Cliente")
    FW.sink_payment_blocks(blocks, os.path.join(tmp_dir, "few"))
    FW.sink_payment_blocks(blocks, os.path.join(tmp_dir, "many"), partitions=4)
    assert len([f for f in os.listdir(os.path.join(tmp_dir, "few")) if f.startswith("part-")]) == 1
    for name in ("few", "many"):
        FW.merge_parts(os.path.join(tmp_dir, name), os.path.join(tmp_dir, f"{name}.txt"))
    want = [r.line for r in R.lines_of_blocks(blocks).orderBy("seq", "sub").collect()]
    assert open(os.path.join(tmp_dir, "few.txt")).read().split("\n") == want == open(os.path.join(tmp_dir, "many.txt")).read().split("\n")


def test_fields_too_wide_raise(spark):
    from decimal import Decimal
    df = spark.createDataFrame([(10_000_000, Decimal("-20.00"))], "nr long, a decimal(38,2)")
    with pytest.raises(Exception, match="payment number wider"):
        df.select(R.rec_40(P, "nr")).collect()
    wide = spark.createDataFrame([(1, Decimal("-200000000000.00"))], "nr long, a decimal(38,2)")
    with pytest.raises(Exception, match="amount wider"):
        wide.select(R.rec_10(P, "nr", "a", F.lit("X" * 16))).collect()
    with pytest.raises(Exception, match="record count wider"):
        df.select(R.rec_tail(P, F.lit(1), F.lit(Decimal("1.00")), F.lit(70_000_002))).collect()


def test_keys_of_customers_that_are_prefixes_of_each_other(spark, tmp_dir):
    from decimal import Decimal

    from tessera.plans.refunds import attach_codes, keys_from_lines
    codes = ["CL100000", "CL1000000", "CL1000007", "CL10000077"]
    rows = [(c, Decimal("-15.00"), "D" * 16, "N") for c in codes]
    n = number_dense(cands(spark, rows), ["Cliente"], out="nr")
    lines = R.payment_lines(n, P, nr="nr", amount="SaldoCliente", tax_id="CF", name="Denominazione", key="Cliente")
    assert {len(r.line) for r in lines.collect()} == {120}
    movements = spark.createDataFrame([(c,) for c in [*codes, "CL999999"]], "Cliente string")
    want = {r.Cliente: r.CodiceUnivoco for r in attach_codes(movements, P).collect()}
    FW.sink_fixed_width(lines, os.path.join(tmp_dir, "f"))
    read = spark.read.text(os.path.join(tmp_dir, "f")).select(F.col("value").alias("line"))
    assert {r.Cliente: r.CodiceUnivoco for r in keys_from_lines(read).collect()} == {c: want[c] for c in codes}
    assert {r.Cliente: r.CodiceUnivoco for r in attach_codes(movements, P, read).collect()} == {**{c: want[c] for c in codes}, "CL999999": "CL999999"}
    assert sorted(r.CodiceUnivoco for r in FW.scan_fixed_width(spark, os.path.join(tmp_dir, "f")).collect()) == sorted(want[c] for c in codes)
