"""Checked queries over the ledger mapping: filters, joins, aggregates, numbering, records, refund jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold_name, not_like_any
from ..operators import ledger as L
from ..operators import records as R
from ..operators.joins import left_join_suffixed, lookup_fallback
from ..operators.numbering import number_dense
from . import fixtures as X
from . import oracle as O
from . import refunds as J
from . import staging as S
from .registry import register

W = O.with_ledger


# ---- aggregations ------------------------------------------------------------------------------

@register("balance_by_customer", W("SELECT CustomerNo AS Nrcliente, counted AS SaldoCliente FROM by_customer"), double=('SaldoCliente',))
def balance_by_customer(spark, sf):
    _, ea = J.ledger_entry_amounts(spark, sf)
    return L.balance_by_customer(ea)


@register("balance_by_account", W("SELECT CustomerAccountNo AS Utenza, counted AS SaldoFornitura FROM by_account"), double=('SaldoFornitura',))
def balance_by_account(spark, sf):
    _, ea = J.ledger_entry_amounts(spark, sf)
    return L.balance_by_account(ea)


@register("residual_by_document", W("SELECT CustomerNo, DocumentNo AS Nrdocumento, counted AS ImportoResiduoCompleto FROM by_document WHERE counted <> 0"), double=('ImportoResiduoCompleto',))
def residual_by_document(spark, sf):
    _, ea = J.ledger_entry_amounts(spark, sf)
    return L.residual_by_document(ea)


@register("balance_by_customer_updated", W("SELECT CustomerNo AS Nrcliente, counted AS SaldoCliente FROM by_customer"), double=('SaldoCliente',))
def balance_by_customer_updated(spark, sf):
    """The balances of a summary that was brought up to date batch by batch."""
    return L.balance_by_customer(J.summary_in_batches(spark, sf, S.fresh(spark, "summary"))[1].read(combined=False))


@register("residual_by_document_updated", W("SELECT CustomerNo, DocumentNo AS Nrdocumento, counted AS ImportoResiduoCompleto FROM by_document WHERE counted <> 0"), double=('ImportoResiduoCompleto',))
def residual_by_document_updated(spark, sf):
    return L.residual_by_document(J.summary_in_batches(spark, sf, S.fresh(spark, "summary"))[1].read(combined=False))


@register("credits_by_code", W("SELECT Codice_Cliente, Avere FROM credit_sums"), double=('Avere',))
def credits_by_code(spark, sf):
    return L.credits_by_code(X.credits(spark, sf))


@register("refund_total", W("""SELECT count(*) AS n_payments, CAST(COALESCE(SUM(SaldoCliente), 0) AS DOUBLE) AS total_amount,
       count(*) * 7 + 2 AS record_count FROM cand_dom"""))
def refund_total(spark, sf):
    return R.refund_totals(J.candidates_domiciled(spark, sf), "SaldoCliente")


def record_count(spark, sf):
    n = J.numbered_domiciled(spark, sf)
    lines = R.payment_lines(n, J.params("domiciled"), nr="nr", amount="SaldoCliente", tax_id="CF",
                            name="Denominazione", key="Cliente")
    # one aggregate over both inputs: physical lines, and 7 per payment + header + trailer
    both = (lines.select(F.lit(1).alias("is_line"), F.lit(0).alias("is_payment"))
            .unionByName(n.select(F.lit(0).alias("is_line"), F.lit(1).alias("is_payment"))))
    return both.agg(F.sum("is_line").cast("bigint").alias("n_lines"),
                    (F.sum("is_payment") * R.LINES_PER_PAYMENT + 2).cast("bigint").alias("record_count"))


@register("distinct_rows", W("SELECT DISTINCT CustomerNo AS Cliente FROM ca_account WHERE AccountStatus IN (1, 4, 5)"))
def distinct_rows(spark, sf):
    a = X.accounts(spark, sf)
    return a.where(F.col("AccountStatus").isin(*L.DOMICILED_STATUSES)).select(F.col("CustomerNo").alias("Cliente")).distinct()


# ---- filters -----------------------------------------------------------------------------------

@register("filter_half_open", W("SELECT CustomerAccountNo AS Utenza, every AS SaldoFornitura FROM by_account WHERE every >= -6000 AND every < -10"), double=('SaldoFornitura',))
def filter_half_open(spark, sf):
    _, ea = J.ledger_entry_amounts(spark, sf)
    b = L.balance_by_account(ea, exclude_documents=False)
    return b.where(L.filter_half_open(F.col("SaldoFornitura"), L.RANGE_LO, L.RANGE_HI))


@register("filter_closed", W("SELECT CustomerNo AS Nrcliente, counted AS SaldoCliente FROM by_customer WHERE counted BETWEEN -6000 AND -10"), double=('SaldoCliente',))
def filter_closed(spark, sf):
    _, ea = J.ledger_entry_amounts(spark, sf)
    return L.balance_by_customer(ea).where(L.filter_closed(F.col("SaldoCliente"), L.RANGE_LO, L.RANGE_HI))


@register("filter_negative", W("SELECT CustomerAccountNo AS Utenza, counted AS SaldoFornitura FROM by_account WHERE counted < 0"), double=('SaldoFornitura',))
def filter_negative(spark, sf):
    _, ea = J.ledger_entry_amounts(spark, sf)
    return L.balance_by_account(ea).where(F.col("SaldoFornitura") < 0)


@register("filter_status_in", W("SELECT No, AccountStatus FROM ca_account WHERE AccountStatus IN (1, 4, 5)"), bigint=('AccountStatus',))
def filter_status_in(spark, sf):
    return X.accounts(spark, sf).where(F.col("AccountStatus").isin(*L.DOMICILED_STATUSES)).select("No", "AccountStatus")


@register("filter_flags", W("SELECT No FROM c_customer WHERE CreateEnrichedXML = 0 AND IndividualPerson = 1"))
def filter_flags(spark, sf):
    c = X.customers(spark, sf)
    return c.where((F.col("CreateEnrichedXML") == 0) & (F.col("IndividualPerson") == 1)).select("No")


@register("filter_excluded", W("SELECT No FROM c_customer WHERE No NOT IN (SELECT CustomerNo FROM x_excluded)"))
def filter_excluded(spark, sf):
    return L.not_excluded(X.customers(spark, sf), "No", X.excluded(spark, sf)).select("No")


@register("filter_not_like_or", W("""SELECT EntryNo, DocumentNo FROM cle_entry
       WHERE NOT (DocumentNo LIKE '%CRP%' OR DocumentNo LIKE '%CRN%')"""))
def filter_not_like_or(spark, sf):
    e = X.entries(spark, sf)
    return e.where(not_like_any("DocumentNo", *L.EXCLUDED_DOC_MARKS)).select("EntryNo", "DocumentNo")


@register("filter_length", W("SELECT No, FiscalCode FROM c_customer WHERE LENGTH(FiscalCode) = 16"))
def filter_length(spark, sf):
    c = X.customers(spark, sf)
    return c.where(F.length("FiscalCode") == L.FISCAL_CODE_LEN).select("No", "FiscalCode")


@register("filter_having", W("SELECT CustomerNo AS Nrcliente, counted AS Saldo FROM by_customer WHERE counted <> 0"), double=('Saldo',))
def filter_having(spark, sf):
    _, ea = J.ledger_entry_amounts(spark, sf)
    return (ea.groupBy(F.col("CustomerNo").alias("Nrcliente")).agg(F.sum("detail_sum_open").alias("Saldo"))
            .where(F.col("Saldo") != 0))


# ---- joins -------------------------------------------------------------------------------------

@register("join_account_customer", W("""SELECT a.No, a.CustomerNo, a.AccountStatus, k.FiscalCode, k.FullName
       FROM c_customer k JOIN ca_account a ON a.CustomerNo = k.No"""), bigint=('AccountStatus',))
def join_account_customer(spark, sf):
    a, c = X.accounts(spark, sf), X.customers(spark, sf).withColumnRenamed("No", "CNo")
    return a.join(c, c.CNo == a.CustomerNo, "inner").select("No", "CustomerNo", "AccountStatus", "FiscalCode", "FullName")


@register("join_left_customer_balance", W("""SELECT a.No, a.CustomerNo, b.counted AS SaldoCliente
       FROM ca_account a LEFT JOIN by_customer b USING (CustomerNo)"""), double=('SaldoCliente',))
def join_left_customer_balance(spark, sf):
    _, ea = J.ledger_entry_amounts(spark, sf)
    a = X.accounts(spark, sf)
    sc = L.balance_by_customer(ea)
    return a.join(sc, a.CustomerNo == sc.Nrcliente, "left").select("No", "CustomerNo", "SaldoCliente")


@register("join_left_account_balance", W("""SELECT a.No, a.CustomerNo, s.counted AS SaldoFornitura
       FROM ca_account a LEFT JOIN by_account s ON s.CustomerAccountNo = a.No"""), double=('SaldoFornitura',))
def join_left_account_balance(spark, sf):
    _, ea = J.ledger_entry_amounts(spark, sf)
    a = X.accounts(spark, sf)
    b = L.balance_by_account(ea)
    return a.join(b, a.No == b.Utenza, "left").select("No", "CustomerNo", "SaldoFornitura")


@register("join_movements_fanout", W("""SELECT c.Cliente, d.DocumentNo AS Nrdocumento, d.counted AS ImportoResiduoCompleto
       FROM cand_dom c JOIN by_document d ON d.CustomerNo = c.Cliente AND d.counted <> 0"""), double=('ImportoResiduoCompleto',))
def join_movements_fanout(spark, sf):
    mv = J.movements_with_codes(spark, sf)
    return mv.select("Cliente", "Nrdocumento", "ImportoResiduoCompleto").distinct()


def entry_sum(details, *conditions):
    """Correlated scalar subquery: the summed details of the outer row's entry."""
    own = details.where(F.col("CustLedgerEntryNo") == F.col("EntryNo").outer())
    for c in conditions:
        own = own.where(c)
    return own.select(F.sum("Amount")).scalar()


@register("correlated_detail_sum", W("SELECT CustomerNo AS Nrcliente, every AS SaldoCliente FROM by_customer"), double=('SaldoCliente',))
def correlated_detail_sum(spark, sf):
    """A scalar subquery for each entry, summed by customer; Catalyst decorrelates it to a left join."""
    e = X.entries(spark, sf).select(F.col("CustomerNo").alias("Nrcliente"), entry_sum(X.details(spark, sf)).alias("v"))
    return e.groupBy("Nrcliente").agg(F.sum("v").alias("SaldoCliente"))


@register("correlated_detail_sum_outer_pred", W("SELECT CustomerAccountNo AS Utenza, counted AS SaldoFornitura FROM by_account"), double=('SaldoFornitura',))
def correlated_detail_sum_outer_pred(spark, sf):
    """The same with a condition on the outer row alone: excluded entries give null, their groups stay."""
    kept = not_like_any(F.col("DocumentNo").outer(), *L.EXCLUDED_DOC_MARKS)
    e = X.entries(spark, sf).select(F.col("CustomerAccountNo").alias("Utenza"), entry_sum(X.details(spark, sf), kept).alias("v"))
    return e.groupBy("Utenza").agg(F.sum("v").alias("SaldoFornitura"))


@register("join_left_unmatched", W("SELECT Codice_Cliente, Avere, CF_PIVA, Name FROM credit_sums s LEFT JOIN cust_names n ON s.Codice_Cliente = n.Cliente"), double=('Avere',))
def join_left_unmatched(spark, sf):
    credits = L.credits_by_code(X.credits(spark, sf))
    return left_join_suffixed(credits, J.customer_names(spark, sf), "Codice_Cliente", "Cliente")


KEY_MAP_SQL = f"SELECT Cliente AS k, Cliente || '00' || {O.alnum('Cliente', 20)} AS CodiceUnivoco FROM cand_dom"


@register("map_lookup_fallback", W(f"""SELECT s.Codice_Cliente, COALESCE(m.CodiceUnivoco, s.Codice_Cliente) AS CodiceUnivoco
       FROM credit_sums s LEFT JOIN ({KEY_MAP_SQL}) m ON s.Codice_Cliente = m.k"""))
def map_lookup_fallback(spark, sf):
    keys = J.keys_from_lines(J.lines_domiciled(spark, sf)).select(F.col("Cliente").alias("k"), "CodiceUnivoco")
    credits = L.credits_by_code(X.credits(spark, sf)).select("Codice_Cliente")
    return lookup_fallback(credits, "Codice_Cliente", keys, "k", "CodiceUnivoco", "CodiceUnivoco")


# ---- numbering and ordering ----------------------------------------------------------------------

@register("number_dense", W("SELECT Cliente, row_number() OVER (ORDER BY Cliente) AS nr FROM cand_dom"))
def number_dense_q(spark, sf):
    return number_dense(J.candidates_domiciled(spark, sf), ["Cliente"], out="nr").select("Cliente", "nr")


@register("number_gapped", W("SELECT Codice_Cliente, Avere, nr FROM cand_nim"), double=('Avere',))
def number_gapped_q(spark, sf):
    return J.candidates_unallocated(spark, sf).select("Codice_Cliente", "Avere", "nr")


@register("order_by_customer", W("SELECT Cliente, SaldoCliente, CF, Denominazione FROM cand_dom ORDER BY Cliente"), double=('SaldoCliente',))
def order_by_customer(spark, sf):
    # DISTINCT + ORDER BY resolves on the output alias (trap T5).
    return J.candidates_domiciled(spark, sf).orderBy("Cliente")


@register("group_sorted", W("SELECT Codice_Cliente, Avere FROM credit_sums ORDER BY Codice_Cliente"), double=('Avere',))
def group_sorted(spark, sf):
    return L.credits_by_code(X.credits(spark, sf)).orderBy("Codice_Cliente")


# ---- composite refund jobs ---------------------------------------------------------------------

@register("refund_candidates_domiciled", W("SELECT * FROM cand_dom"), double=('SaldoCliente',))
def refund_candidates_domiciled(spark, sf):
    return J.candidates_domiciled(spark, sf)


@register("refund_candidates_ordinary", W("SELECT * FROM cand_ord"), double=('SaldoFornitura', 'SaldoCliente'))
def refund_candidates_ordinary(spark, sf):
    return J.candidates_ordinary(spark, sf)


MOVEMENTS_SQL = W(f"""SELECT c.Cliente, c.SaldoCliente, c.CF, c.Denominazione, d.DocumentNo AS Nrdocumento,
         round_even(d.counted, 2) AS ImportoResiduoCompleto, c.Cliente || '00' || {O.alnum('c.Cliente', 20)} AS CodiceUnivoco
  FROM cand_dom c JOIN by_document d ON d.CustomerNo = c.Cliente
  WHERE d.counted <> 0""")


@register("refund_movements", MOVEMENTS_SQL, double=("SaldoCliente", "ImportoResiduoCompleto"))
def refund_movements(spark, sf):
    return J.movements_with_codes(spark, sf)


@register("refund_candidates_unallocated", W("SELECT Codice_Cliente, Avere, CF_PIVA, Name, nr FROM cand_nim"), double=('Avere',))
def refund_candidates_unallocated(spark, sf):
    return J.candidates_unallocated(spark, sf)


DOM_N = "cand_dom_n AS (SELECT *, row_number() OVER (ORDER BY Cliente) AS nr FROM cand_dom)"
ORD_N = "cand_ord_n AS (SELECT *, row_number() OVER (ORDER BY Cliente, Fornitura) AS nr FROM cand_ord)"


def _w_lines(extra_cte: str, body: str) -> str:
    return "WITH " + O.LEDGER.strip() + ",\n" + extra_cte + "\n" + body


DOM_LINES = O.lines_sql("cand_dom_n", "nr", "SaldoCliente", "CF", "Denominazione", "Cliente", ordinary=False)
ORD_LINES = O.lines_sql("cand_ord_n", "nr", "SaldoFornitura", "CF", None, "Fornitura", ordinary=True)
NIM_LINES = O.lines_sql("cand_nim", "nr", "Avere", "CF_PIVA", "Name", "Codice_Cliente", ordinary=False)


@register("refund_lines_domiciled", _w_lines(DOM_N, DOM_LINES))
def refund_lines_domiciled(spark, sf):
    return J.lines_domiciled(spark, sf)


@register("refund_lines_ordinary", _w_lines(ORD_N, ORD_LINES))
def refund_lines_ordinary(spark, sf):
    return J.lines_ordinary(spark, sf)


@register("refund_lines_unallocated", W(NIM_LINES))
def refund_lines_unallocated(spark, sf):
    return J.lines_unallocated(spark, sf)


@register("filter_prefix", _w_lines(DOM_N, f"SELECT seq, line FROM ({DOM_LINES}) t WHERE line LIKE ' 70%'"))
def filter_prefix(spark, sf):
    return J.lines_domiciled(spark, sf).where(F.col("line").startswith(" 70")).select("seq", "line")


@register("record_count", _w_lines(DOM_N, f"""SELECT (SELECT count(*) FROM ({DOM_LINES}) t) AS n_lines,
       count(*) * 7 + 2 AS record_count FROM cand_dom_n"""))
def record_count_q(spark, sf):
    return record_count(spark, sf)


# ---- record builders (one key per record type, over the numbered domiciled candidates) ---------

def _rec_sql(where: str) -> str:
    return _w_lines(DOM_N, f"SELECT seq, sub, line FROM ({DOM_LINES}) t WHERE {where}")


def _body(sub: int, make):
    def q(spark, sf):
        n = J.numbered_domiciled(spark, sf)
        return n.select(F.col("nr").alias("seq"), F.lit(sub).cast("bigint").alias("sub"),
                        make(J.params("domiciled")).alias("line"))
    return q


register("rec_10", _rec_sql("sub = 1"))(_body(1, lambda p: R.rec_10(p, "nr", "SaldoCliente", "CF")))
register("rec_20", _rec_sql("sub = 2"))(_body(2, lambda p: R.rec_20(p, "nr")))
register("rec_30", _rec_sql("sub = 3"))(_body(3, lambda p: R.rec_30(p, "nr", "Denominazione")))
register("rec_40", _rec_sql("sub = 4"))(_body(4, lambda p: R.rec_40(p, "nr")))
register("rec_70", _rec_sql("sub = 7"))(_body(7, lambda p: R.rec_70(p, "nr", "Cliente")))


@register("rec_60", _rec_sql("sub IN (5, 6)"))
def rec_60(spark, sf):
    n = J.numbered_domiciled(spark, sf)
    a, b = R.rec_60(J.params("domiciled"), "nr")
    return (n.select(F.col("nr").alias("seq"), F.posexplode(F.array(a, b)))
            .select("seq", (F.col("pos") + 5).cast("bigint").alias("sub"), F.col("col").alias("line")))


@register("rec_head", _rec_sql("seq = 0 AND sub = 0"))
def rec_head(spark, sf):
    return J.lines_domiciled(spark, sf).where((F.col("seq") == 0) & (F.col("sub") == 0))


@register("rec_tail", _rec_sql("seq > 0 AND sub = 0"))
def rec_tail(spark, sf):
    n = J.numbered_domiciled(spark, sf)
    t = n.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("SaldoCliente"), F.lit(0)).alias("total"),
              F.max("nr").alias("mx"))
    return t.select((F.coalesce("mx", F.lit(0)) + 1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("sub"),
                    R.rec_tail(J.params("domiciled"), F.col("n"), F.col("total"), F.col("n") * 7 + 2).alias("line"))
