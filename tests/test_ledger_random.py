"""Randomized ledgers near the range bounds: Spark operators against the rules in plain Python."""

import random
from decimal import Decimal

import pytest

from tessera.operators import ledger as L

BOUNDARY = [Decimal(x) for x in ("-10.00", "-9.99", "-10.01", "-6000.00", "-6000.01", "-5999.99", "-3.33", "-6.67",
                                 "0.01", "-0.01", "2000.00", "-2000.00", "-1999.99", "0.00", "-12.50", "-25.00",
                                 "-100.00", "-4000.00", "-5990.00")]



def balances(ent, det, key):
    """Summed details by key of the entry: (all, without credit notes); None where nothing counts."""
    of_entry = {}
    for entry, amount in det:
        of_entry[entry] = of_entry.get(entry, Decimal(0)) + amount
    out = {}
    for row in ent:
        pair = out.setdefault(key(row), [None, None])
        value, document = of_entry.get(row[0]), row[3]
        if value is None:
            continue
        pair[0] = (pair[0] or Decimal(0)) + value
        if document is not None and "CRP" not in document and "CRN" not in document:
            pair[1] = (pair[1] or Decimal(0)) + value
    return out


def expected(data):
    """Domiciled candidates, ordinary candidates and movements by the rules, in plain Python."""
    cus, acc, ent, det, exc = (data[k] for k in ("cus", "acc", "ent", "det", "exc"))
    of_customer = balances(ent, det, lambda r: r[1])
    of_account = balances(ent, det, lambda r: r[2])
    of_document = balances(ent, det, lambda r: (r[1], r[3]))
    customer = {c[0]: c for c in cus}
    excluded = {x[0] for x in exc}
    domiciled, ordinary = set(), []
    for no, owner, status in acc:
        mine, whole = of_account.get(no, [None, None]), of_customer.get(owner, [None, None])
        tax, xml, person = customer[owner][1], customer[owner][4], customer[owner][5]
        if (status in (1, 4, 5) and whole[1] is not None and -6000 <= whole[1] <= -10 and mine[1] is not None and mine[1] < 0
                and tax is not None and len(tax) == 16 and owner not in excluded):
            domiciled.add((owner, whole[1], tax))
        if (status == 1 and mine[0] is not None and -6000 <= mine[0] < -10 and whole[0] is not None and whole[0] < 0 and xml == 0 and person == 1):
            ordinary.append((no, mine[0], owner, whole[0]))
    chosen = {d[0] for d in domiciled}
    movements = [(c, d, v[1]) for (c, d), v in of_document.items() if c in chosen and v[1] is not None and v[1] != 0]
    return domiciled, ordinary, movements


def random_ledger(seed: int):
    rnd = random.Random(seed)
    cus, acc, ent, det = [], [], [], []
    for c in range(rnd.randint(15, 25)):
        no = f"CL{c:06d}"
        cf = rnd.choice(["A" * 16, "B" * 16, "D" * 16, "C" * 15, None])
        cus.append((no, cf, f"NOME {c}", None, rnd.randint(0, 1), rnd.randint(0, 1)))
        for a in range(rnd.randint(1, 3)):
            ano = f"{c}{a}"
            acc.append((ano, no, rnd.choice([0, 1, 1, 4, 5])))
            for e in range(rnd.randint(0, 4)):
                eno = len(ent) + 1
                # the entry's customer is usually the account's owner, sometimes another customer
                ecus = no if rnd.random() < 0.9 else f"CL{rnd.randint(0, 5):06d}"
                ent.append((eno, ecus, ano, rnd.choice(["FT1", "FT2", "CRP9", "XCRN", None])))
                for _ in range(rnd.randint(0, 3)):
                    det.append((eno, rnd.choice(BOUNDARY)))
    exc = [(c[0],) for c in cus if rnd.random() < 0.15]
    return cus, acc, ent, det, exc


SCHEMAS = {
    "cus": "No string, FiscalCode string, FullName string, Name string, CreateEnrichedXML int, IndividualPerson int",
    "acc": "No string, CustomerNo string, AccountStatus int",
    "ent": "EntryNo bigint, CustomerNo string, CustomerAccountNo string, DocumentNo string",
    "det": "CustLedgerEntryNo bigint, Amount decimal(18,2)",
    "exc": "CustomerNo string",
}


def as_sets(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("seed", list(range(6)))
def test_candidates_and_movements_match_the_rules(spark, seed):
    data = dict(zip(["cus", "acc", "ent", "det", "exc"], random_ledger(seed)))
    dfs = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in data.items()}
    domiciled, ordinary, movements = expected(data)
    summary = L.ledger_summary(L.entry_amounts(dfs["ent"], dfs["det"]))
    dom = L.refund_candidates_domiciled(dfs["acc"], dfs["cus"], summary, dfs["exc"]).select("Cliente", "SaldoCliente", "CF")
    assert as_sets(dom.collect()) == as_sets(domiciled)
    ord_ = L.refund_candidates_ordinary(dfs["acc"], dfs["cus"], summary).select("Fornitura", "SaldoFornitura", "Cliente",
                                                                              "SaldoCliente")
    assert as_sets(ord_.collect()) == as_sets(ordinary)
    pairs = L.ledger_summary(L.entry_amounts(dfs["ent"], dfs["det"]), documents=False)
    cands = L.refund_candidates_domiciled(dfs["acc"], dfs["cus"], pairs, dfs["exc"])
    assert as_sets(cands.select("Cliente", "SaldoCliente", "CF").collect()) == as_sets(domiciled)
    mv = L.refund_movements(cands, summary).select("Cliente", "Nrdocumento", "ImportoResiduoCompleto")
    assert as_sets(mv.collect()) == as_sets(movements)
    # the direct roll-ups agree with the summary roll-ups
    ea = L.entry_amounts(dfs["ent"], dfs["det"])
    assert as_sets(L.balance_by_customer(ea).collect()) == as_sets(L.balance_by_customer(summary).collect())


def test_hot_customer_third_of_rows(spark):
    """One customer owns a third of the accounts and entries; small AQE partitions force skew handling."""
    cus, acc, ent, det = [], [], [], []
    for c in range(30):
        cus.append((f"CL{c:06d}", "A" * 16, f"N{c}", None, 0, 1))
    for a in range(600):
        owner = 0 if a % 3 == 0 else 1 + a % 29
        ano = f"A{a}"
        acc.append((ano, f"CL{owner:06d}", [1, 4, 5, 0][a % 4]))
        for e in range(3):
            eno = len(ent) + 1
            ent.append((eno, f"CL{owner:06d}", ano, ["FT1", "CRP2", f"FT{a}"][e]))
            det.append((eno, [Decimal("-0.50"), Decimal("0.25"), Decimal("-2.00")][(a + e) % 3]))
            det.append((eno, Decimal("-1.00")))
    data = {"cus": cus, "acc": acc, "ent": ent, "det": det, "exc": [("CL000007",)]}
    confs = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        dfs = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in data.items()}
        summary = L.ledger_summary(L.entry_amounts(dfs["ent"], dfs["det"]))
        cands = L.refund_candidates_domiciled(dfs["acc"], dfs["cus"], summary, dfs["exc"])
        mv = L.refund_movements(cands, summary).select("Cliente", "Nrdocumento", "ImportoResiduoCompleto")
        dom_rows, mv_rows = cands.select("Cliente", "SaldoCliente", "CF").collect(), mv.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want_dom, _, want_mv = expected(data)
    assert len(want_dom) > 0 and as_sets(dom_rows) == as_sets(want_dom)
    assert as_sets(mv_rows) == as_sets(want_mv)
