"""Tiny files written by the tests: CSV policies, preamble files, XML, nested archives, routing."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.plans import jobs as JB
from tessera.sources import archives as A
from tessera.sources import csv as CSV
from tessera.sources import listing as LS
from tessera.sources import preamble as P
from tessera.sources import xml as XML

SF_SMALL = "/root/testdata/sf0.001"


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(text.encode(encoding))


def test_bad_rows_long_dropped_short_kept(spark, tmp_dir):
    write(f"{tmp_dir}/in/a.csv", "A;B;C\n1;2;3\n4;5;6;7\n8;9\n\"x;y\";z;w\n10;NA;\n", "latin-1")
    got = [tuple(r) for r in CSV.scan_csv_bad_rows(spark, f"{tmp_dir}/in").collect()]
    assert got == [("1", "2", "3"), ("8", "9", None), ("x;y", "z", "w"), ("10", None, None)]


def test_latin1_and_null_tokens(spark, tmp_dir):
    write(f"{tmp_dir}/in/a.csv", "CITTÀ,PROV\nForlì,NA\nAosta,AO\nRoma,NULL\n", "latin-1")
    got = [tuple(r) for r in CSV.scan_csv_text(spark, f"{tmp_dir}/in", sep=",").collect()]
    assert got == [("Forlì", None), ("Aosta", "AO"), ("Roma", None)]
    kept = [tuple(r) for r in CSV.scan_csv_text(spark, f"{tmp_dir}/in", sep=",", tokens=[]).collect()]
    assert ("Forlì", "NA") in kept


def test_typed_keeps_identifier_zeros(spark, tmp_dir):
    write(f"{tmp_dir}/in/a.csv", "PIVA;N;D\n00123;7;2024-01-05\n", "latin-1")
    r = CSV.scan_csv_typed(spark, f"{tmp_dir}/in", {"N": "bigint", "D": "date"}).first()
    assert r.PIVA == "00123" and r.N == 7 and str(r.D) == "2024-01-05"


def registry_text(months):
    head = "POD;CF;PIVA;Tipo_Misuratore;T1;T2;" + ";".join(f"EA_F{b}_{m}" for m in months for b in (1, 2, 3))
    head += ";CONSUMO_TOT;CONSUMO_F1;CONSUMO_F2;CONSUMO_F3;REGIME_COMPENSAZIONE"
    vals = ["IT001E123456789", "CF1", "00012345678", "ORARIO", "A", "B"]
    vals += [f"{b}.{m}" for m in months for b in (1, 2, 3)]
    vals += ["1,5", "0,5", "0,5", "0,5", "X"]
    return "Distributore Uno;NORD;-;01234567890\n" + head + "\n" + ";".join(vals) + "\n"


def test_registry_import_december_and_month_order(spark, tmp_dir):
    fwd = JB.MONTH_ORDER
    write(f"{tmp_dir}/reg/202412_a.csv", registry_text(fwd))
    write(f"{tmp_dir}/reg/202403_b.csv", registry_text(list(reversed(fwd))))
    write(f"{tmp_dir}/reg/202405_c.csv", "Distributore Due;SUD;-;999\n" + registry_text(fwd).split("\n")[1] + "\n")
    out = JB.registry_import(spark, f"{tmp_dir}/reg").orderBy("Anno", "Mese").collect()
    assert [(r.Anno, r.Mese) for r in out] == [(2024, 4), (2025, 1)]  # header-only file gives no rows
    for r in out:
        assert r.POD == "IT001E12345678" and r.PIVA == "00012345678"
        assert r.F2_07 == float("2.07") and r.F3_05 == float("3.05") and r.CONSUMO_TOT == 1.5
        assert (r.Ragione_Sociale_Distributore, r.Zona, r.Piva_Distributore) == ("Distributore Uno", "NORD",
                                                                               "01234567890")
    assert list(out[0].asDict()) == JB.REGISTRY_COLUMNS


def test_nested_archives(spark, tmp_dir):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/RCU_REP_ELE_00000000000202411_x.csv", "A;B\n1;2\n")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("top.csv", "A;B\n3;4\n")
    os.makedirs(f"{tmp_dir}/zips")
    open(f"{tmp_dir}/zips/batch.ZIP", "wb").write(outer.getvalue())
    members = sorted((r.member, bytes(r.content)) for r in A.expand_archives(spark, f"{tmp_dir}/zips").collect())
    assert members == [("inner.zip!/deep/RCU_REP_ELE_00000000000202411_x.csv", b"A;B\n1;2\n"), ("top.csv", b"A;B\n3;4\n")]
    listing = A.extract_archives(spark, f"{tmp_dir}/zips", f"{tmp_dir}/out").collect()
    assert len(listing) == 2 and all(os.path.exists(r.path) for r in listing)
    names = spark.createDataFrame([(r.member.split("/")[-1],) for r in listing], "name string")
    assert tuple(LS.period_of_batch(names).first()) == (2024, 11)


def test_period_defaults_without_match(spark):
    names = spark.createDataFrame([("a.csv",)], "name string")
    assert tuple(LS.period_of_batch(names).first()) == (0, 0)


def test_filename_period_next(spark):
    df = spark.createDataFrame([("202412_x.csv",), ("202401_y.csv",)], "n string")
    y, m = D.filename_period_next(F.col("n"))
    assert [tuple(r) for r in df.select(y, m).collect()] == [(2025, 1), (2024, 2)]


def test_xml_rows_and_price_import(spark, tmp_dir):
    xml = ("<NewDataSet><xs:schema xmlns:xs='http://www.w3.org/2001/XMLSchema' id='NewDataSet'>"
           "<xs:element name='Prezzi'/></xs:schema>"
           "<Prezzi><Data>20240105</Data><Mercato>MGP</Mercato><Ora>1</Ora><NORD>45,5</NORD><SUD>40</SUD></Prezzi>"
           "<Prezzi><Data>20240105</Data><Mercato>MGP</Mercato><Ora>2</Ora><NORD>46,25</NORD></Prezzi>"
           "</NewDataSet>")
    write(f"{tmp_dir}/px/20240105MGPPrezzi.xml", xml)
    write(f"{tmp_dir}/px/20240109MGPPrezzi.xml", xml.replace("20240105", "20240109"))
    rows = XML.scan_xml_rows(spark, f"{tmp_dir}/px")
    assert sorted(rows.columns) == ["Data", "NORD", "Ora", "SUD"] and rows.count() == 4
    # files of other days are not opened: this one is no XML at all
    write(f"{tmp_dir}/px/20300101MGPPrezzi.xml", "<NewDataSet><Prezzi><Data>20300101</Data><ALTRO>1</AL")
    out = JB.price_import(spark, f"{tmp_dir}/px", "2024-01-04", "2024-01-06").orderBy("Ora", "Zona").collect()
    assert [(str(r.Data), r.Ora, r.Zona, r.Prezzo) for r in out] == [
        ("2024-01-05", 1, "NORD", 45.5), ("2024-01-05", 1, "SUD", 40.0), ("2024-01-05", 2, "NORD", 46.25)]


def test_price_import_without_files(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/px")
    assert JB.price_import(spark, f"{tmp_dir}/px", "2024-01-04", "2024-01-06").count() == 0


def test_route_and_date_range(spark):
    names = spark.createDataFrame([("a.zip",), ("x_REP_ELE_1.csv",), ("flusso_15.csv",), ("libreria_gas.xlsx",),
                                   ("libreria_ee.xlsx",)], "name string")
    assert [r.r for r in names.select(LS.route("name").alias("r")).collect()] == [
        "archive", "supply_points", "flow15", "gas_library", "electricity_library"]
    listing = spark.createDataFrame([("20240102MGPPrezzi.xml",), ("20240105MGPPrezzi.xml",)], "name string")
    got = [r.name for r in LS.date_range_files(spark, "2024-01-01", "2024-01-04", listing).collect()]
    assert got == ["20240102MGPPrezzi.xml"]


def test_preamble_fields_by_name(spark, tmp_dir):
    write(f"{tmp_dir}/p/202401_a.csv", "Co;Z;V\nB;A\n2;1\n3\n")
    rows = P.scan_preamble_csv(spark, f"{tmp_dir}/p").orderBy("line_no").collect()
    assert [(r.company, r.zone, r.vat, r.fields.get("A"), r.fields.get("B")) for r in rows] == [
        ("Co", "Z", "V", "1", "2"), ("Co", "Z", "V", None, "3")]


def test_preamble_file_split_over_many_tasks(spark, tmp_dir):
    body = "\n".join(f"{i};{i * 2}" for i in range(3000))
    write(f"{tmp_dir}/big/202401_a.csv", "Co;Z;V\nA;B\n" + body + "\n")
    write(f"{tmp_dir}/big/202402_b.csv", "Co2;Z2;V2\nB;A\n" + body + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "2048")
    try:
        df = P.scan_preamble_csv(spark, f"{tmp_dir}/big")
        assert df.rdd.getNumPartitions() > 4
        rows = df.select("company", P.field("A").alias("a"), P.field("B").alias("b")).collect()
    finally:
        spark.conf.set(key, old)
    assert len(rows) == 6000
    a = sorted((int(r.a), int(r.b)) for r in rows if r.company == "Co")
    b = sorted((int(r.b), int(r.a)) for r in rows if r.company == "Co2")
    assert a == b == [(i, i * 2) for i in range(3000)]


def test_long_rows_raise_drop_or_stay_apart(spark, tmp_dir):
    write(f"{tmp_dir}/in/a.csv", 'a;b\n1;2\n3;4;5\n4;5;\n7;8;;x\n"x;y";z\n9\n', "latin-1")
    with pytest.raises(Exception, match="more fields than its header"):
        CSV.scan_csv_text(spark, f"{tmp_dir}/in").collect()
    kept = [tuple(r) for r in CSV.scan_csv_text(spark, f"{tmp_dir}/in", long_rows="drop").collect()]
    assert kept == [("1", "2"), ("x;y", "z"), ("9", None)]
    assert CSV.scan_csv_text(spark, f"{tmp_dir}/in", long_rows="drop").count() == 3
    apart = CSV.scan_long_rows(spark, f"{tmp_dir}/in")
    assert apart.count() == 3 and {tuple(r) for r in apart.collect()} == {("a.csv", "3;4;5"), ("a.csv", "4;5;"), ("a.csv", "7;8;;x")}
    # a scan of few columns sees the same rows
    assert CSV.scan_csv_text(spark, f"{tmp_dir}/in", long_rows="drop").select("b").count() == 3


def test_files_read_by_their_own_header(spark, tmp_dir):
    write(f"{tmp_dir}/in/a.csv", "a;b;c\n1;2;3\n", "latin-1")
    write(f"{tmp_dir}/in/sub/b.csv", "c;b;a\n33;22;11\n", "latin-1")
    write(f"{tmp_dir}/in/c.csv", "a;d\n7;8\n", "latin-1")
    got = {(r.a, r.b, r.c, r.d) for r in CSV.scan_csv_text(spark, f"{tmp_dir}/in").collect()}
    assert got == {("1", "2", "3", None), ("11", "22", "33", None), ("7", None, None, "8")}


def test_registry_quotes_empty_cells_and_long_rows(spark, tmp_dir):
    text = registry_text(JB.MONTH_ORDER).split("\n")
    row = text[2].split(";")
    row[3], row[10], row[-2] = '"ORARIO; notte"', "", "NA"
    write(f"{tmp_dir}/reg/202403_a.csv", "\n".join(['"IT; SPA";NORD;-;9', text[1], ";".join(row), ""]))
    r = JB.registry_import(spark, f"{tmp_dir}/reg").collect()
    assert len(r) == 1 and r[0].Ragione_Sociale_Distributore == "IT; SPA" and r[0].Tipo_Misuratore == "ORARIO; notte"
    assert r[0].CONSUMO_F3 is None and [c for c in JB.REGISTRY_COLUMNS if r[0][c] is None] == ["F2_07", "CONSUMO_F3"]
    write(f"{tmp_dir}/reg/202404_b.csv", "\n".join(["Co;Z;-;1", text[1], text[2] + ";more", ""]))
    with pytest.raises(Exception, match="202404_b.csv"):
        JB.registry_import(spark, f"{tmp_dir}/reg").collect()
    assert JB.registry_import(spark, f"{tmp_dir}/reg", long_rows="drop").count() == 1


def test_preamble_rows_equal_to_titles_are_kept(spark, tmp_dir):
    """Rows are told from titles by their place: a body row may repeat the preamble, the titles or both; no join in the plan."""
    write(f"{tmp_dir}/p/202401_a.csv", "\ufeffCo;Z;V\r\nA;B;C\r\nA;B;C\r\nCo;Z;V\r\n\r\n1;2;3")
    write(f"{tmp_dir}/p/202402_b.csv", "A;B\nA;B\nA;B\n")
    write(f"{tmp_dir}/p/_202402_c.csv", "no;file\nA;B\n1;2\n")
    write(f"{tmp_dir}/p/202403_empty.csv", "")
    write(f"{tmp_dir}/p/202403_short.csv", "one line")
    df = P.scan_preamble_csv(spark, f"{tmp_dir}/p")
    got = sorted((r.file_name, r.company, r.vat, r.line_no, r.fields) for r in df.collect())
    assert [(f, c, v, sorted(m.items())) for f, c, v, _, m in got] == [
        ("202401_a.csv", "Co", "V", [("A", "A"), ("B", "B"), ("C", "C")]), ("202401_a.csv", "Co", "V", [("A", "Co"), ("B", "Z"), ("C", "V")]),
        ("202401_a.csv", "Co", "V", [("A", "1"), ("B", "2"), ("C", "3")]), ("202402_b.csv", "A", "B", [("A", "A"), ("B", "B")])]
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_cover_every_line_once(tmp_dir):
    """All ways to cut a file, with lines longer than a block, empty lines and a last line without an end."""
    import random

    from tessera.sources import ranges as R
    r = random.Random(2)
    for _ in range(30):
        data = b"".join(b"x" * r.choice([0, 1, 3, 40]) + r.choice([b"\n", b"\r\n"]) for _ in range(r.randrange(12))) + b"y" * r.randrange(3)
        want, at = [], 0
        for line in data.split(b"\n"):
            if at < len(data):
                want.append((at, line.removesuffix(b"\r")))
            at += len(line) + 1
        size = r.randrange(1, 20)
        got = [x for a in range(0, len(data), size) for x in R.range_lines(io.BytesIO(data), a, a + size, block=r.randrange(1, 9))]
        assert got == want
    files = [("a", 1000), ("b", 10), ("c", 0), ("d", 90)]
    for target, cost, n in ((100, 5, 4), (10**6, 5, 1), (7, 0, 3)):
        parts = R.packed_ranges(files, target, cost, n)
        for path, size in files:
            own = sorted((x.start, x.stop) for p in parts for x in p.ranges if x.path == path)
            assert [b - a for a, b in own if b <= a] == [] and sum(b - a for a, b in own) == size
            assert all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


def test_registry_titles_twice_name_the_file(spark, tmp_dir):
    write(f"{tmp_dir}/p/202401_a.csv", "Co;Z;V\nB;A;A\n2;1;3\n")
    with pytest.raises(Exception, match="202401_a.csv"):
        P.scan_preamble_csv(spark, f"{tmp_dir}/p").collect()


def test_archives_keep_equal_names(spark, tmp_dir):
    for folder, n in (("one", 1), ("two", 2)):
        os.makedirs(f"{tmp_dir}/zips/{folder}")
        with zipfile.ZipFile(f"{tmp_dir}/zips/{folder}/a.zip", "w") as z:
            z.writestr("d1/x.csv", f"A\n{n}\n")
            z.writestr("d2/x.csv", f"A\n{n + 10}\n")
    listing = A.extract_archives(spark, f"{tmp_dir}/zips", f"{tmp_dir}/out").collect()
    assert len({r.path for r in listing}) == 4
    assert sorted(r.A for r in CSV.scan_csv_text(spark, f"{tmp_dir}/out").collect()) == ["1", "11", "12", "2"]
    lines = A.archive_lines(spark, f"{tmp_dir}/zips").where("pos > 0").collect()
    assert sorted(r.line for r in lines) == ["1", "11", "12", "2"]
    plan = A.archive_lines(spark, f"{tmp_dir}/zips")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_one_archive_read_by_many_tasks(spark, tmp_dir):
    """200 members of one archive, some in a stored and some in a compressed nested archive, two levels deep."""
    want, files = {}, {}
    for i in range(200):
        files[f"d{i % 7}/m{i}.csv"] = f"A;B\n{i};é{i}\n" * (1 + i % 5)

    def packed(names, how):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", how) as z:
            for n in names:
                z.writestr(n, files[n].encode("latin-1"))
        return out
    names = sorted(files)
    deep = io.BytesIO()
    with zipfile.ZipFile(deep, "w") as z:
        z.writestr(zipfile.ZipInfo("empty/"), b"")
        z.writestr("deepest.zip", packed(names[:30], zipfile.ZIP_DEFLATED).getvalue(), zipfile.ZIP_STORED)
        z.writestr("after.csv", "x", zipfile.ZIP_DEFLATED)
    os.makedirs(f"{tmp_dir}/zips")
    with zipfile.ZipFile(f"{tmp_dir}/zips/all.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n in names[60:130]:
            z.writestr(n, files[n].encode("latin-1"))
        z.writestr("deep.zip", deep.getvalue(), zipfile.ZIP_STORED)
        z.writestr("squeezed.ZIP", packed(names[30:60], zipfile.ZIP_STORED).getvalue(), zipfile.ZIP_DEFLATED)
        for n in names[130:]:
            z.writestr(n, files[n].encode("latin-1"))
    want = {f"deep.zip!/deepest.zip!/{n}": files[n] for n in names[:30]} | {f"squeezed.ZIP!/{n}": files[n] for n in names[30:60]} | {n: files[n] for n in names[60:]}
    want["deep.zip!/after.csv"] = "x"
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        ranges = A.member_ranges(spark, f"{tmp_dir}/zips")
        tasks = ranges.select(F.spark_partition_id().alias("p"), F.col("last") - F.col("first")).collect()
        got = A.expand_archives(spark, f"{tmp_dir}/zips").collect()
        lines = A.archive_lines(spark, f"{tmp_dir}/zips").groupBy("member").agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set(key, old)
    assert len(tasks) > 10 and len({r.p for r in tasks}) > 5 and max(r[1] for r in tasks) <= 16
    assert {r.member: bytes(r.content).decode("latin-1") for r in got} == want and len(got) == len(want)
    assert {r.member: r.n for r in lines} == {m: len(t.splitlines()) for m, t in want.items()}
    again = A.extract_archives(spark, f"{tmp_dir}/zips", f"{tmp_dir}/out").collect()
    assert {r.member: open(r.path, encoding="latin-1", newline="").read() for r in again} == want


def test_damaged_archive_names_no_rows_silently(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/zips")
    with open(f"{tmp_dir}/zips/bad.zip", "wb") as fh:
        fh.write(b"no archive at all")
    with pytest.raises(Exception, match="zip"):
        A.expand_archives(spark, f"{tmp_dir}/zips").collect()
    os.remove(f"{tmp_dir}/zips/bad.zip")
    with zipfile.ZipFile(f"{tmp_dir}/zips/none.zip", "w"):
        pass
    assert A.expand_archives(spark, f"{tmp_dir}/zips").count() == 0


def fields(r, rows, n):
    """Random delimited text with quoted separators, quotes and line breaks."""
    def one():
        k = r.random()
        if k < 0.3:
            return '"' + "".join(r.choice(["a", '""', "\n", ";", "\r\n", "é"]) for _ in range(r.randrange(6))) + '"'
        return r.choice(['a"b', 'x""y', "NA", "", " "]) if k < 0.5 else "".join(r.choice("abcé") for _ in range(1 + r.randrange(5)))
    return "\n".join(";".join(one() for _ in range(n)) for _ in range(rows))


def test_records_of_ranges(tmp_dir):
    """Quoted line breaks at every place of a range: records of all ranges are those of the whole file, each once."""
    import csv
    import random

    from tessera.sources import delimited as D
    from tessera.sources.ranges import line_blocks
    r = random.Random(6)
    parse = lambda b: list(csv.reader(io.StringIO(b.decode(), newline=""), delimiter=";"))
    for _ in range(400):
        data = (fields(r, r.randrange(1, 8), r.randrange(1, 4)) + r.choice(["", "\n"])).encode()
        size, block, inside, got = r.randrange(1, 30), r.randrange(1, 20), False, []
        for at in range(0, len(data), size):
            for part in D.record_blocks(io.BytesIO(data), at, at + size, inside, b";", block):
                got += parse(part)
            state = [False, True]
            for part in line_blocks(io.BytesIO(data), at, at + size, block):
                state = [D.quoted_spans(part, s, b";")[1] for s in state]
            inside = state[inside]
        assert got == parse(data)


def test_inside_ranges_compose(spark):
    """The window over two-valued functions gives the state that going through the ranges gives."""
    import random

    from tessera.sources import delimited as D
    r = random.Random(7)
    rows = [(f"f{p}", k * 10, r.randrange(2), r.randrange(2)) for p in range(12) for k in range(r.randrange(1, 25))]
    want = set()
    for p in {x[0] for x in rows}:
        state = 0
        for path, start, outside, inside in sorted(x for x in rows if x[0] == p):
            if state:
                want.add((path, start))
            state = inside if state else outside
    assert {tuple(x) for x in D.inside_ranges(spark.createDataFrame(rows, D.STATES_SCHEMA)).collect()} == want


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_line_breaks_in_fields_of_a_cut_file(spark, tmp_dir, encoding):
    import csv
    import random
    r = random.Random(8)
    rows = [f"{i};" + fields(r, 1, 2) for i in range(1500)]
    write(f"{tmp_dir}/in/a.csv", "i;x;y\n" + "\n".join(rows) + "\n", encoding)
    write(f"{tmp_dir}/in/b.csv", "y;i\n\"two\nlines\";b\n", encoding)
    want = [x + [None] * (3 - len(x)) for x in csv.reader(io.StringIO("\n".join(rows) + "\n", newline=""), delimiter=";")]
    df = CSV.scan_csv_text(spark, f"{tmp_dir}/in", encoding=encoding, tokens=[], range_bytes=2000)
    assert df.rdd.getNumPartitions() > 5 and df.columns == ["i", "x", "y"]
    got = {x.i: (x.x, x.y) for x in df.collect()}
    assert got == {x[0]: (x[1], x[2]) for x in want} | {"b": (None, "two\nlines")}


def test_quote_never_closed_raises(spark, tmp_dir):
    write(f"{tmp_dir}/in/a.csv", 'a;b\n1;2\n3;"4\n5;6\n')
    with pytest.raises(Exception, match="never closed"):
        CSV.scan_csv_text(spark, f"{tmp_dir}/in").collect()


def test_many_headers_one_scan(spark, tmp_dir):
    """200 files of 200 column orders: one scan in the plan, rows by name."""
    import random
    r = random.Random(9)
    names = [f"c{i}" for i in range(12)]
    for k in range(200):
        own = r.sample(names, r.randrange(8, 13))
        write(f"{tmp_dir}/in/f{k:03d}.csv", ";".join(["k", *own]) + "\n" + ";".join([str(k), *[f"{k}-{c}" for c in own]]) + "\n", "latin-1")
    df = CSV.scan_csv_text(spark, f"{tmp_dir}/in")
    assert sorted(df.columns) == sorted(["k", *names])
    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    rows = df.collect()
    assert len(rows) == 200 and all(x[c] in (None, f"{x.k}-{c}") for x in rows for c in names)
    assert sum(x[c] is not None for x in rows for c in names) > 200 * 8


def test_split_long_rows_in_one_pass(spark, tmp_dir):
    write(f"{tmp_dir}/in/a.csv", 'a;b\n1;2\n3;4;5\n4;NA;\n"x;\ny";"q""z"\n9\n', "latin-1")
    write(f"{tmp_dir}/in/b.csv", "b\n7\n8;9\n", "latin-1")
    assert CSV.split_long_rows(spark, f"{tmp_dir}/in", f"{tmp_dir}/out") == {"good": 4, "long": 3}
    good = spark.read.parquet(f"{tmp_dir}/out/rows=good").select("a", "b").collect()
    assert sorted(map(tuple, good), key=str) == sorted([("1", "2"), ("x;\ny", 'q"z'), ("9", None), (None, "7")], key=str)
    long = spark.read.parquet(f"{tmp_dir}/out/rows=long").select(CSV.FILE, CSV.LONG).collect()
    assert sorted(map(tuple, long)) == [("a.csv", "3;4;5"), ("a.csv", "4;NA;"), ("b.csv", "8;9")]


def test_csv_sink_round_trip(spark, tmp_dir):
    from tessera.sinks import tables as SK
    rows = [("1", 'say "hi"'), ("2", "two\nlines"), ("3", "a;b"), ("4", "back\\slash"), ("5", '"')]
    SK.sink_csv(spark.createDataFrame(rows, "k string, v string"), f"{tmp_dir}/out")
    got = CSV.scan_csv_text(spark, f"{tmp_dir}/out", encoding="UTF-8", tokens=[]).collect()
    assert sorted(map(tuple, got)) == rows


# ---- extracted files that stay compressed -------------------------------------------------------

def test_framed_file_reads_from_any_place():
    import random

    from tessera.sources.frames import FramedFile, FrameWriter
    r = random.Random(12)
    for n in (0, 1, 99, 100, 1234):
        data, out = bytes(r.randrange(256) for _ in range(n)), io.BytesIO()
        w, at = FrameWriter(out, frame=100), 0
        while at < n:
            step = r.randrange(1, 300)
            w.write(data[at:at + step])
            at += step
        w.finish()
        f = FramedFile(out, len(out.getvalue()), "x.zst")
        assert f.size == n and f.read() == data and f.read(5) == b""
        for _ in range(50):
            a, k = r.randrange(n + 2), r.randrange(400)
            f.seek(a)
            assert f.read(k) == data[a:a + k]
    with pytest.raises(ValueError, match="list of its frames: y.zst"):
        FramedFile(io.BytesIO(b"no frames at all"), 16, "y.zst")


def test_packed_extraction_is_small_and_read_in_ranges(spark, tmp_dir):
    """Members stay compressed on disk, and are still cut into ranges and read by their own headers."""
    os.makedirs(f"{tmp_dir}/zips")
    rows = [f"{i};\"città\n{i % 7}\"" for i in range(60_000)]
    with zipfile.ZipFile(f"{tmp_dir}/zips/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", ("k;v\n" + "\n".join(rows) + "\n").encode("latin-1"))
        z.writestr("y.csv", "v;k\nb;a\n")
        z.writestr("empty.csv", "")
    listing = A.extract_archives(spark, f"{tmp_dir}/zips", f"{tmp_dir}/out", packed=True).collect()
    sizes = {r.member: (r.size, os.path.getsize(r.path), bytes(r.head)) for r in listing}
    whole = len("k;v\n") + sum(len(x) + 1 for x in rows)
    assert sizes["x.csv"][0] == whole and sizes["x.csv"][1] < whole / 3 and sizes["x.csv"][2] == b"k;v" and sizes["empty.csv"][0] == 0
    df = CSV.scan_csv_text(spark, f"{tmp_dir}/out", range_bytes=50_000)
    assert df.rdd.getNumPartitions() > 5
    got = {x.k: x.v for x in df.collect()}
    assert len(got) == 60_001 and got["a"] == "b" and all(got[str(i)] == f"città\n{i % 7}" for i in range(60_000))


def test_supply_point_job_keeps_extracted_text_compressed(spark, tmp_dir):
    """The job's disk: what it extracts takes a third of the text at most, and staging deals out table rows, not texts."""
    from tessera.plans import jobs as JB
    dest = JB.stage_supply_point_archives(spark, SF_SMALL)
    assert JB.supply_point_import(spark, dest, f"{tmp_dir}/out").count() > 0
    text = sum(r.size for r in A.extract_archives(spark, dest, f"{tmp_dir}/plain").select("size").collect())
    assert 0 < sum(e.stat().st_size for e in os.scandir(f"{tmp_dir}/out")) < text / 3


def test_short_rows_are_read_together(monkeypatch):
    """Rows with too few fields go through the reader of all rows, some at a time, and keep their places, nulls and line breaks."""
    import json
    import types

    from tessera.sources import delimited as D

    def one_by_one(*_, **__):
        raise AssertionError("a row was parsed by itself")

    monkeypatch.setattr(D, "csv", types.SimpleNamespace(reader=one_by_one))
    titles = ["a", "b", "c"]
    reader = D.DelimitedReader({"sep": ";", "encoding": "ISO-8859-1", "longrows": "drop", "tokens": json.dumps(["", "NA"]), "titles": json.dumps(titles)})
    lines = ["0;x;y", "1", '2;"p;\nq"', "3;NA", "4;città;z", "5;x;y;z", '6;"a ""b"" c"', "7;;", "8"]
    got = [tuple(r.values()) for b in reader.parse("".join(f"{x}\n" for x in lines).encode("latin-1"), titles, "f.csv") for r in b.to_pylist()]
    assert got == [("0", "x", "y"), ("1", None, None), ("2", "p;\nq", None), ("3", None, None), ("4", "città", "z"), ("6", 'a "b" c', None), ("7", None, None), ("8", None, None)]


def test_supply_point_job_compiles_its_projections(spark, tmp_dir):
    """In a session with Spark's own limit of method sizes too; a smaller one stays."""
    from tessera.plans import jobs as JB
    key = "spark.sql.codegen.hugeMethodLimit"
    old = spark.conf.get(key)
    try:
        for before, after in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(key, before)
            dest = JB.stage_supply_point_archives(spark, SF_SMALL)
            assert spark.conf.get(key) == after
            spark.conf.set(key, before)
            assert JB.supply_point_import(spark, dest, f"{tmp_dir}/{before}").count() > 0
            assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, old)


# ---- short ranges of large files ----------------------------------------------------------------

def test_tasks_do_not_get_more_with_the_data():
    """Files cut at a fixed length: every byte in one range, and no more tasks for ten times the data."""
    from tessera.sources import ranges as R
    counts = []
    for n in (1, 10):
        files = [(f"f{k}", n * (20 << 20) + k) for k in range(5)]
        parts = R.packed_ranges(files, 128 << 20, 4 << 20, 12, 64 << 10)
        own = sorted((r.path, r.start, r.stop) for p in parts for r in p.ranges)
        assert max(b - a for _, a, b in own) == 64 << 10 and sum(b - a for _, a, b in own) == sum(s for _, s in files)
        assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(own, own[1:], strict=False))
        counts.append(len(parts))
    assert 48 <= counts[1] <= counts[0] + 5 <= 70


def test_a_short_range_reads_little_of_its_file():
    """What a range of 64 KB reads is bounded by its length, not by the size of a block."""
    from tessera.sources import delimited as D
    from tessera.sources.ranges import line_blocks

    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            data = super().read(size)
            self.n += len(data)
            return data

    data = b'1;"x\ny"\n' * 2_000_000
    f, at = Counted(data), 8 * 300_000
    assert b"".join(D.record_blocks(f, at, at + (64 << 10), False, b";")).count(b"x") == 8192
    assert f.n < 5 * (64 << 10)
    f = Counted(data)
    assert sum(map(len, line_blocks(f, at, at + (64 << 10)))) >= 64 << 10
    assert f.n < 5 * (64 << 10)
