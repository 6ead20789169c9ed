"""DuckDB SQL for the oracle check: the ledger mapping as CTEs and small SQL fragment builders.

These strings restate FIXTURES.md independently of the Spark code: every entry gets the sum of its
details once, three roll-ups give the balances, and the candidates are customers (or accounts) that
meet the rules, the account rules as EXISTS.
"""

from __future__ import annotations

from .fixtures import PAYER_NAME, RUN_DATE, RUN_ID


def pad_left(expr: str, fill: str, n: int) -> str:
    return f"(CASE WHEN length({expr}) < {n} THEN lpad({expr}, {n}, '{fill}') ELSE {expr} END)"


def pad_right(expr: str, fill: str, n: int) -> str:
    return f"(CASE WHEN length({expr}) < {n} THEN rpad({expr}, {n}, '{fill}') ELSE {expr} END)"


def code(expr: str) -> str:
    return f"('CL' || {pad_left(f'CAST({expr} AS VARCHAR)', '0', 6)})"


def fold(expr: str) -> str:
    out = f"left(upper(replace({expr}, 'ß', 'ss')), 90)"
    for src, dst in [("Ù", "U''"), ("Ò", "O''"), ("Ì", "I''"), ("È", "E''"), ("À", "A''")]:
        out = f"replace({out}, '{src}', '{dst}')"
    return out


def alnum(key_expr: str, n: int) -> str:
    return f"upper(left(sha256('{RUN_ID}' || '|' || CAST({key_expr} AS VARCHAR)), {n}))"


def digits(key_expr: str, n: int) -> str:
    return f"translate(left(sha256('{RUN_ID}' || '|' || CAST({key_expr} AS VARCHAR)), {n}), 'abcdef', '012345')"


def cents(expr: str) -> str:
    return pad_left(f"CAST(CAST(abs(round_even(CAST({expr} AS DECIMAL(38,6)), 2)) * 100 AS DECIMAL(38,0)) AS VARCHAR)",
                    "0", 3)


def blanks(n: int) -> str:
    return "'" + " " * n + "'"


def run_date(fmt: str) -> str:
    return f"strftime(DATE '{RUN_DATE}', '{fmt}')"


LEDGER = f"""
ca_account AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS No, {code('o_custkey')} AS CustomerNo,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 4 ELSE 0 END AS AccountStatus
  FROM orders),
c_customer AS (
  SELECT {code('c_custkey')} AS No,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE left(upper(md5(CAST(c_custkey AS VARCHAR))), 16) END AS FiscalCode,
         c_name AS FullName, c_mktsegment AS Name,
         CASE WHEN c_custkey % 5 = 0 THEN {pad_left('CAST(c_custkey AS VARCHAR)', '0', 11)} END AS VATRegistrationNo,
         CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS CreateEnrichedXML,
         CASE WHEN c_custkey % 5 <> 0 THEN 1 ELSE 0 END AS IndividualPerson
  FROM customer),
cle_entry AS (
  SELECT p.l_orderkey * 10 + p.l_linenumber AS EntryNo, {code('o.o_custkey')} AS CustomerNo,
         CAST(p.l_orderkey AS VARCHAR) AS CustomerAccountNo,
         (CASE p.l_linenumber WHEN 7 THEN 'CRP' WHEN 6 THEN 'CRN' ELSE 'FT' END) || CAST(p.l_orderkey AS VARCHAR) AS DocumentNo
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) p JOIN orders o ON p.l_orderkey = o.o_orderkey),
dcle_detail AS (
  SELECT l_orderkey * 10 + l_linenumber AS CustLedgerEntryNo,
         CAST((CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END) * l_quantity * (l_discount - CAST(0.04 AS DOUBLE)) * CAST(10 AS DOUBLE) AS DECIMAL(18,2)) AS Amount
  FROM lineitem),
x_excluded AS (SELECT {code('c_custkey')} AS CustomerNo FROM customer WHERE c_custkey % 97 = 0),
entry_value AS (
  SELECT e.CustomerNo, e.CustomerAccountNo, e.DocumentNo, t.total AS every,
         CASE WHEN contains(e.DocumentNo, 'CRP') OR contains(e.DocumentNo, 'CRN') THEN NULL
              WHEN e.DocumentNo IS NOT NULL THEN t.total END AS counted
  FROM cle_entry e
  LEFT JOIN (SELECT CustLedgerEntryNo AS EntryNo, sum(Amount) AS total FROM dcle_detail GROUP BY ALL) t USING (EntryNo)),
by_customer AS (SELECT CustomerNo, sum(every) AS every, sum(counted) AS counted FROM entry_value GROUP BY ALL),
by_account AS (SELECT CustomerAccountNo, sum(every) AS every, sum(counted) AS counted FROM entry_value GROUP BY ALL),
by_document AS (SELECT CustomerNo, DocumentNo, sum(counted) AS counted FROM entry_value GROUP BY ALL),
cand_dom AS (
  SELECT k.No AS Cliente, round_even(b.counted, 2) AS SaldoCliente, k.FiscalCode AS CF,
         {fold('COALESCE(k.FullName, k.Name)')} AS Denominazione
  FROM by_customer b JOIN c_customer k ON k.No = b.CustomerNo
  WHERE b.counted BETWEEN -6000 AND -10 AND length(k.FiscalCode) = 16
    AND NOT EXISTS (FROM x_excluded x WHERE x.CustomerNo = k.No)
    AND EXISTS (FROM by_account s JOIN ca_account a ON a.No = s.CustomerAccountNo
                WHERE a.CustomerNo = k.No AND s.counted < 0 AND a.AccountStatus IN (1, 4, 5))),
cand_ord AS (
  SELECT a.No AS Fornitura, round_even(s.every, 2) AS SaldoFornitura, k.No AS Cliente,
         round_even(b.every, 2) AS SaldoCliente, k.FiscalCode AS CF, k.FullName AS Denominazione
  FROM by_account s
  JOIN ca_account a ON a.No = s.CustomerAccountNo AND a.AccountStatus = 1
  JOIN c_customer k ON k.No = a.CustomerNo AND k.IndividualPerson = 1 AND k.CreateEnrichedXML = 0
  JOIN by_customer b ON b.CustomerNo = k.No AND b.every < 0
  WHERE s.every >= -6000 AND s.every < -10),
credits AS (
  SELECT (CASE WHEN o_custkey % 11 = 0 THEN 'xx' ELSE 'cl' END) || {pad_left('CAST(o_custkey AS VARCHAR)', '0', 6)} AS Codice_Cliente,
         CAST(floor(o_totalprice / 100) - 2400 AS DECIMAL(18,2)) AS Avere
  FROM orders),
credit_sums AS (
  SELECT upper(Codice_Cliente) AS Codice_Cliente, COALESCE(SUM(Avere), 0) AS Avere
  FROM credits WHERE Codice_Cliente IS NOT NULL GROUP BY upper(Codice_Cliente)),
cust_names AS (
  SELECT No AS Cliente, COALESCE(FiscalCode, VATRegistrationNo) AS CF_PIVA, {fold('COALESCE(FullName, Name)')} AS Name
  FROM c_customer),
cand_nim_all AS (
  SELECT s.Codice_Cliente, s.Avere, n.CF_PIVA, n.Name,
         row_number() OVER (ORDER BY s.Codice_Cliente, n.CF_PIVA, n.Name) AS nr
  FROM credit_sums s LEFT JOIN cust_names n ON s.Codice_Cliente = n.Cliente),
cand_nim AS (SELECT * FROM cand_nim_all WHERE Avere >= 10 AND Avere <= 6000)
"""


def with_ledger(body: str) -> str:
    return "WITH " + LEDGER.strip() + "\n" + body


# ---- payment file lines ----------------------------------------------------------------------


def _nr(expr: str) -> str:
    return pad_left(f"CAST({expr} AS VARCHAR)", "0", 7)


def flow(ordinary: bool) -> str:
    return alnum("'flow'", 5) if ordinary else f"('BD-' || {digits(chr(39) + 'flow' + chr(39), 9)})"


def line_code(ordinary: bool) -> str:
    if ordinary:
        return flow(True)
    return f"('BD-' || {alnum(chr(39) + 'line' + chr(39), 8)} || '-' || {run_date('%Y%m%d')} || '  ')"


def lines_sql(source: str, nr: str, amount: str, tax_id: str | None, name: str | None, key: str,
              ordinary: bool, total_of: str | None = None) -> str:
    """Header, 7 records per payment and trailer (seq, sub, line) from the rows of CTE ``source``."""
    n = _nr(nr)
    tax = f"COALESCE({tax_id}, '')" if tax_id else "''"
    r10 = (f"' 10' || {n} || {blanks(12)} || {run_date('%d%m%y')} || '48000' || {pad_left(cents(amount), '0', 13)}"
           f" || '+' || {line_code(ordinary)} || '07601' || {blanks(22)} || '3' || {tax} || {blanks(6)} || 'E'")
    if ordinary:
        r20 = f"' 20' || {n} || {blanks(110)}"
        r30 = f"' 30' || {n} || {blanks(110)}"
        r60a = f"' 60' || {n} || 'SEG160' || {blanks(100)}"
        r60b = f"' 60' || {n} || 'SEG260' || {blanks(100)}"
        r70 = f"' 70' || {n} || {blanks(46)} || {alnum(key, 30)} || {blanks(34)}"
        head = f"' PC14191' || '60199' || {run_date('%d%m%y')} || {flow(True)} || {blanks(89)} || 'E' || {blanks(6)}"
        tblank = 21
    else:
        payer = pad_right(f"'{PAYER_NAME}'", " ", 30)
        r20 = f"' 20' || {n} || {payer} || {blanks(80)}"
        r30 = f"' 30' || {n} || {pad_right(f'COALESCE({name}, {chr(39)}{chr(39)})', ' ', 90)} || {blanks(20)}"
        r60a = f"' 60' || {n} || 'SEG160' || {blanks(104)}"
        r60b = f"' 60' || {n} || 'SEG260' || {blanks(104)}"
        r70 = f"' 70' || {n} || {blanks(46)} || {key} || '00' || {alnum(key, 20)} || {blanks(34)}"
        head = f"' PC14191' || '60199' || {run_date('%d%m%y')} || {flow(False)} || {blanks(82)} || 'E' || {blanks(6)}"
        tblank = 14
    recs = [r10, r20, r30, "' 40' || " + n + " || " + blanks(110), r60a, r60b, r70]
    body = " UNION ALL ".join(
        f"SELECT CAST({nr} AS BIGINT) AS seq, CAST({i + 1} AS BIGINT) AS sub, {r} AS line FROM {source}"
        for i, r in enumerate(recs))
    tot = total_of or amount
    tail = (f"SELECT CAST(COALESCE(max({nr}), 0) + 1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS sub, "
            f"' EF' || '14191' || '60199' || {run_date('%d%m%y')} || {flow(ordinary)} || {blanks(tblank)} || "
            f"{pad_left('CAST(count(*) AS VARCHAR)', '0', 7)} || {blanks(15)} || "
            f"{pad_left(cents(f'COALESCE(SUM({tot}), 0)'), '0', 15)} || "
            f"{pad_left('CAST(count(*) * 7 + 2 AS VARCHAR)', '0', 7)} || {blanks(24)} || 'E' || {blanks(6)} AS line "
            f"FROM {source}")
    head_q = f"SELECT CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS sub, {head} AS line"
    return f"{head_q} UNION ALL {body} UNION ALL {tail}"
