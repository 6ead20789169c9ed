"""Ledger balances and refund-candidate selection.

Shared plan: details are aggregated by entry once (map-side partial aggregation collapses a hot
entry before the shuffle), joined 1:1 to entries, aggregated once more to (customer, account,
document) — the ledger summary, written back as a table — and rolled up from there to customers,
accounts and (customer, document). The correlated scalar subquery of the reference
(``SUM((SELECT SUM(amount) … WHERE no = entry AND NOT doc LIKE …))``) becomes a left join plus a
``when`` on the outer-row predicate, so an excluded entry contributes null while its customer
still gets a group (trap T14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_2
from ..functions.text import fold_name, not_like_any

# Fixed values of the selection rules.
EXCLUDED_DOC_MARKS = ("CRP", "CRN")
DOMICILED_STATUSES = (1, 4, 5)
ORDINARY_STATUS = 1
RANGE_LO, RANGE_HI = -6000, -10
CREDIT_LO, CREDIT_HI = 10, 6000
FISCAL_CODE_LEN = 16


def detail_sum_by_entry(details: DataFrame) -> DataFrame:
    """Sum of detail amounts per ledger entry (one row per entry that has details)."""
    return details.groupBy("CustLedgerEntryNo").agg(F.sum("Amount").alias("detail_sum"))


def entry_amounts(entries: DataFrame, details: DataFrame) -> DataFrame:
    """Entry-level table: keys, the raw detail sum and the sum seen through the document predicate.

    ``detail_sum`` is null for an entry without details; ``detail_sum_open`` is also null when the
    document is a CRP/CRN note or null (three-valued ``NOT (LIKE OR LIKE)``).
    """
    sums = detail_sum_by_entry(details)
    e = entries.join(sums, entries.EntryNo == sums.CustLedgerEntryNo, "left").drop("CustLedgerEntryNo")
    keep = not_like_any("DocumentNo", *EXCLUDED_DOC_MARKS)
    return e.withColumn("detail_sum_open", F.when(keep, F.col("detail_sum")))


def _amount_col(exclude_documents: bool) -> str:
    return "detail_sum_open" if exclude_documents else "detail_sum"


def ledger_summary(entry_amts: DataFrame, documents: bool = True, open_documents: bool = True, materialize: bool = True) -> DataFrame:
    """One aggregate at (customer, account) grain, with ``documents`` at (customer, account, document) grain.

    Customer, account and document balances are all roll-ups of this table (a sum of partial
    sums, null only when every contribution is null, equals the direct sum), so the entry-level
    join and its shuffle run once for all of them. Near entry grain with documents, so jobs that
    give no movements leave them out; the ordinary job also leaves out the sum it does not use
    (``open_documents=False``). ``materialize`` writes the table to the shared checkpoint folder:
    the roll-ups read it instead of recomputing the ledger, and a lost executor does not replay it. The result keeps
    the column names of ``entry_amounts`` so every roll-up below accepts either table.
    """
    keys = ["CustomerNo", "CustomerAccountNo", *(["DocumentNo"] if documents else [])]
    sums = [F.sum("detail_sum").alias("detail_sum"), *([F.sum("detail_sum_open").alias("detail_sum_open")] if open_documents else [])]
    summary = entry_amts.groupBy(*keys).agg(*sums)
    if materialize:
        from ..session import materialize as write_back
        summary = write_back(summary, "ledger-summary")
    return summary


SUMMARY_KEYS = ["CustomerNo", "CustomerAccountNo", "DocumentNo"]
SUMMARY_SCHEMA = ("CustomerNo string, CustomerAccountNo string, DocumentNo string, "
                  "detail_sum decimal(38,2), detail_sum_open decimal(38,2)")


def combine_summaries(rows: DataFrame) -> DataFrame:
    """Rows of several summaries as one: sums of sums, null only where all are null."""
    cents = lambda c: F.sum(c).cast("decimal(38,2)").alias(c)
    return rows.groupBy(*SUMMARY_KEYS).agg(cents("detail_sum"), cents("detail_sum_open"))


def summary_table(spark, path: str, buckets: int = 64):
    """The ledger summary as a table that is kept up to date by ``update_summary``."""
    from ..sinks.keyed import KeyedTable
    return KeyedTable(spark, path, SUMMARY_SCHEMA, SUMMARY_KEYS, combine_summaries, buckets)


def update_summary(table, batch: int, entries: DataFrame, new_entries: DataFrame, new_details: DataFrame) -> int:
    """Bring a ``summary_table`` up to date with what came in since the batch before; buckets touched.

    ``new_details`` may belong to old entries or to new ones; ``entries`` are all old ones (read for
    the new details' keys only, never their old details), and new entries without details count too.
    A batch that is run again changes nothing: it starts from the state before it.
    """
    old = entries.join(new_details.select(F.col("CustLedgerEntryNo").alias("EntryNo")).distinct(), "EntryNo", "left_semi")
    columns = ["EntryNo", *SUMMARY_KEYS]
    touched = old.select(*columns).unionByName(new_entries.select(*columns))
    return table.merge(batch, entry_amounts(touched, new_details))


def balance_by_customer(entry_amts: DataFrame, exclude_documents: bool = True) -> DataFrame:
    """``SaldoCliente`` per customer; null when no entry contributes."""
    return (entry_amts.groupBy(F.col("CustomerNo").alias("Nrcliente"))
            .agg(F.sum(_amount_col(exclude_documents)).alias("SaldoCliente")))


def balance_by_account(entry_amts: DataFrame, exclude_documents: bool = True) -> DataFrame:
    """``SaldoFornitura`` per account; null when no entry contributes."""
    return (entry_amts.groupBy(F.col("CustomerAccountNo").alias("Utenza"))
            .agg(F.sum(_amount_col(exclude_documents)).alias("SaldoFornitura")))


def residual_by_document(entry_amts: DataFrame) -> DataFrame:
    """Open amount per (customer, document), kept when ``!= 0`` (a null sum fails the test)."""
    return (entry_amts.groupBy("CustomerNo", F.col("DocumentNo").alias("Nrdocumento"))
            .agg(F.sum("detail_sum_open").alias("ImportoResiduoCompleto"))
            .where(F.col("ImportoResiduoCompleto") != 0))


def accounts_with_balances(accounts: DataFrame, customers: DataFrame, entry_amts: DataFrame,
                           exclude_documents: bool) -> DataFrame:
    """Accounts ⋈ customers, left-joined to both balances (the later range filter makes them inner)."""
    sc = balance_by_customer(entry_amts, exclude_documents)
    sf = balance_by_account(entry_amts, exclude_documents)
    ca = accounts.alias("CA")
    c = customers.alias("C")
    j = ca.join(c, F.col("C.No") == F.col("CA.CustomerNo"), "inner")
    j = j.join(sc, F.col("CA.CustomerNo") == sc.Nrcliente, "left")
    j = j.join(sf, F.col("CA.No") == sf.Utenza, "left")
    return j


def filter_closed(c: Column, lo, hi) -> Column:
    return (c >= lo) & (c <= hi)


def filter_half_open(c: Column, lo, hi) -> Column:
    """``lo <= c < hi`` (strict upper bound)."""
    return (c >= lo) & (c < hi)


def not_excluded(df: DataFrame, key: str, excluded: DataFrame, excluded_key: str = "CustomerNo") -> DataFrame:
    """``key NOT IN (excluded)`` as a left-anti join; Spark broadcasts the exclusion side when its size allows."""
    ex = excluded.select(F.col(excluded_key).alias("__ex")).distinct()
    return df.join(ex, df[key] == ex["__ex"], "left_anti")


def refund_candidates_domiciled(accounts: DataFrame, customers: DataFrame, entry_amts: DataFrame,
                                excluded: DataFrame, lo=RANGE_LO, hi=RANGE_HI) -> DataFrame:
    """Customers to refund by domiciled transfer, one row per customer.

    Columns: Cliente, SaldoCliente, CF, Denominazione. Account status in (1, 4, 5), customer balance
    in the closed range [lo, hi] (before rounding), some account balance < 0, fiscal code of 16
    characters, customer not excluded, CRP/CRN documents ignored in all balances.
    """
    j = accounts_with_balances(accounts, customers, entry_amts, exclude_documents=True)
    j = j.where(F.col("CA.AccountStatus").isin(*DOMICILED_STATUSES)
                & filter_closed(F.col("SaldoCliente"), lo, hi)
                & (F.col("SaldoFornitura") < 0)
                & (F.length(F.col("C.FiscalCode")) == FISCAL_CODE_LEN))
    j = not_excluded(j, "CA.CustomerNo", excluded)
    out = j.select(F.col("CA.CustomerNo").alias("Cliente"),
                   F.col("SaldoCliente"),
                   F.col("C.FiscalCode").alias("CF"),
                   fold_name(F.col("C.FullName"), F.col("C.Name")).alias("Denominazione")).distinct()
    return out.withColumn("SaldoCliente", round_2("SaldoCliente"))


def refund_candidates_ordinary(accounts: DataFrame, customers: DataFrame, entry_amts: DataFrame,
                               lo=RANGE_LO, hi=RANGE_HI) -> DataFrame:
    """Accounts to refund by ordinary transfer, one row per account.

    Columns: Fornitura, SaldoFornitura, Cliente, SaldoCliente, CF, Denominazione. Status 1, account
    balance in the half-open range [lo, hi), customer balance < 0, CreateEnrichedXML = 0 and
    IndividualPerson = 1. All documents count.
    """
    j = accounts_with_balances(accounts, customers, entry_amts, exclude_documents=False)
    j = j.where((F.col("CA.AccountStatus") == ORDINARY_STATUS)
                & filter_half_open(F.col("SaldoFornitura"), lo, hi)
                & (F.col("SaldoCliente") < 0)
                & (F.col("C.CreateEnrichedXML") == 0) & (F.col("C.IndividualPerson") == 1))
    return j.select(F.col("CA.No").alias("Fornitura"),
                    round_2("SaldoFornitura").alias("SaldoFornitura"),
                    F.col("CA.CustomerNo").alias("Cliente"),
                    round_2("SaldoCliente").alias("SaldoCliente"),
                    F.col("C.FiscalCode").alias("CF"),
                    F.col("C.FullName").alias("Denominazione"))


def refund_movements(candidates: DataFrame, entry_amts: DataFrame) -> DataFrame:
    """Domiciled candidates fanned out to their open documents (one row per customer and document).

    Columns: Cliente, SaldoCliente, CF, Denominazione, Nrdocumento, ImportoResiduoCompleto.

    All output columns other than the document are per customer, and the account conditions of a
    candidate are existential, so the one-row-per-customer candidates are joined to the customer's
    documents: no accounts × documents expansion, and the join is 1:N on the customer key.
    """
    mv = residual_by_document(entry_amts).withColumnRenamed("CustomerNo", "MvCustomerNo")
    out = candidates.join(mv, candidates.Cliente == mv.MvCustomerNo, "inner").drop("MvCustomerNo")
    return out.withColumn("ImportoResiduoCompleto", round_2("ImportoResiduoCompleto"))


def credits_by_code(credits: DataFrame, code: str = "Codice_Cliente", amount: str = "Avere") -> DataFrame:
    """Upper-cased code → summed credit; null codes dropped, null amounts skipped, all-null sum = 0."""
    return (credits.where(F.col(code).isNotNull())
            .groupBy(F.upper(F.col(code)).alias(code))
            .agg(F.coalesce(F.sum(amount), F.lit(0).cast("decimal(38,2)")).alias(amount)))
