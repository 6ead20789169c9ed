"""Composite refund jobs: candidates → numbers → payment lines → reconciliation.

The user jobs (``tessera.api``) and the checked queries run the same functions: each takes the ledger
tables (any object with accounts, customers, entries, details and excluded) and the run's parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import coalesce_id, fold_name
from ..operators import ledger as L
from ..operators.joins import left_join_suffixed, lookup_fallback
from ..operators.numbering import number_dense, number_gapped
from ..operators.records import KEY_FIELD, KEY_OFFSET, FileParams, payment_blocks, payment_key, payment_lines
from . import fixtures as X


def params(variant: str) -> FileParams:
    return FileParams(variant=variant, run_date=X.RUN_DATE, run_id=X.RUN_ID, payer_name=X.PAYER_NAME)


def ledger_entry_amounts(spark: SparkSession, sf_dir: str):
    led = X.ledger(spark, sf_dir)
    return led, L.entry_amounts(led.entries, led.details)


class DomiciledRun:
    """One domiciled refund run. Candidates need balances by (customer, account) only; a run that also
    gives movements (``documents``) summarises by document, once for both. A run that is handed a
    ``summary`` (that of ``ledger.summary_table``) reads no entries and no details."""

    def __init__(self, ledger, run: FileParams, documents: bool = False, summary: DataFrame | None = None):
        self.ledger, self.run = ledger, run
        self.summary = L.ledger_summary(L.entry_amounts(ledger.entries, ledger.details), documents=documents) if summary is None else summary
        self._candidates = None
        self._numbered = None

    def candidates(self) -> DataFrame:
        if self._candidates is None:
            self._candidates = L.refund_candidates_domiciled(self.ledger.accounts, self.ledger.customers, self.summary,
                                                             self.ledger.excluded)
        return self._candidates

    def numbered(self) -> DataFrame:
        """Candidates with their payment numbers, a written table."""
        if self._numbered is None:
            self._numbered = number_dense(self.candidates(), ["Cliente"], out="nr")
        return self._numbered

    def blocks(self) -> DataFrame:
        return payment_blocks(self.numbered(), self.run, nr="nr", amount="SaldoCliente", tax_id="CF",
                              name="Denominazione", key="Cliente")

    def lines(self) -> DataFrame:
        return payment_lines(self.numbered(), self.run, nr="nr", amount="SaldoCliente", tax_id="CF",
                             name="Denominazione", key="Cliente")

    def movements(self, lines: DataFrame | None = None) -> DataFrame:
        """Open documents of the candidates with their payment keys (read back from written ``lines`` when given)."""
        cands = self._numbered.drop("nr") if self._numbered is not None else self.candidates()
        return attach_codes(L.refund_movements(cands, self.summary), self.run, lines)


def keys_from_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``(Cliente, CodiceUnivoco)`` of the record-70 lines of a payment file that was read back: the whole
    key field, and the customer as everything before the key's last 22 characters (``00`` and 20 of code)."""
    key = F.rtrim(F.substring(F.col(line_col), KEY_OFFSET + 1, KEY_FIELD))
    keys = lines.where(F.col(line_col).startswith(" 70")).select(key.alias("CodiceUnivoco"))
    return keys.select(F.expr("left(CodiceUnivoco, length(CodiceUnivoco) - 22)").alias("Cliente"), "CodiceUnivoco")


def attach_codes(movs: DataFrame, run: FileParams, lines: DataFrame | None = None) -> DataFrame:
    """Movements with ``CodiceUnivoco``. The key is a function of run and customer, so it is a column;
    with ``lines`` (a written file read back) it is looked up there by the whole customer code, and a
    customer without a payment keeps its own code."""
    if lines is None:
        return movs.withColumn("CodiceUnivoco", payment_key(run, F.col("Cliente")))
    keys = keys_from_lines(lines).withColumnRenamed("Cliente", "k")
    return lookup_fallback(movs, "Cliente", keys, "k", "CodiceUnivoco", "CodiceUnivoco")


def ordinary_candidates(ledger, summary: DataFrame | None = None) -> DataFrame:
    if summary is None:
        summary = L.ledger_summary(L.entry_amounts(ledger.entries, ledger.details), documents=False, open_documents=False)
    return L.refund_candidates_ordinary(ledger.accounts, ledger.customers, summary)


def ordinary_numbered(ledger) -> DataFrame:
    # Ties on the customer are broken by the account number (trap T17).
    return number_dense(ordinary_candidates(ledger), ["Cliente", "Fornitura"], out="nr")


def ordinary_layout() -> dict:
    return {"nr": "nr", "amount": "SaldoFornitura", "tax_id": "CF", "name": None, "key": "Fornitura"}


def names_of(customers: DataFrame) -> DataFrame:
    """Customer code, fiscal code or VAT number, folded name (the unallocated job's customer query)."""
    return customers.select(F.col("No").alias("Cliente"), coalesce_id("FiscalCode", "VATRegistrationNo").alias("CF_PIVA"),
                            fold_name("FullName", "Name").alias("Name"))


def unallocated_numbered(credits: DataFrame, customers: DataFrame, lo=L.CREDIT_LO, hi=L.CREDIT_HI) -> DataFrame:
    """Credits summed by upper-cased code, left-joined to customers, numbered in code order before the
    closed-range filter on the credit (numbers keep gaps). Unmatched codes stay with null CF and name."""
    joined = left_join_suffixed(L.credits_by_code(credits), names_of(customers), "Codice_Cliente", "Cliente")
    return number_gapped(joined, ["Codice_Cliente", "CF_PIVA", "Name"], L.filter_closed(F.col("Avere"), lo, hi), out="nr")


def unallocated_layout() -> dict:
    return {"nr": "nr", "amount": "Avere", "tax_id": "CF_PIVA", "name": "Name", "key": "Codice_Cliente", "total_of": "Avere"}


# ---- the same on the driver tables, for the checked queries --------------------------------------

def domiciled_run(spark: SparkSession, sf_dir: str, documents: bool = False) -> DomiciledRun:
    return DomiciledRun(X.ledger(spark, sf_dir), params("domiciled"), documents)


def candidates_domiciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domiciled_run(spark, sf_dir).candidates()


def candidates_ordinary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinary_candidates(X.ledger(spark, sf_dir))


def movements_with_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domiciled_run(spark, sf_dir, documents=True).movements()


def customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names_of(X.customers(spark, sf_dir))


def candidates_unallocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unallocated_numbered(X.credits(spark, sf_dir), X.customers(spark, sf_dir))


def numbered_domiciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domiciled_run(spark, sf_dir).numbered()


def lines_domiciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domiciled_run(spark, sf_dir).lines()


def lines_ordinary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_lines(ordinary_numbered(X.ledger(spark, sf_dir)), params("ordinary"), **ordinary_layout())


def lines_unallocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_lines(candidates_unallocated(spark, sf_dir), params("unallocated"), **unallocated_layout())


def summary_in_batches(spark: SparkSession, sf_dir: str, path: str, batches: int = 3):
    """The summary of the driver tables' ledger, brought up to date batch by batch: entries come in by their
    number, and a fifth of the details a batch later than their entry. Of the old entries, an update is handed
    those its details name. The last batch runs twice."""
    led = X.ledger(spark, sf_dir)
    table = L.summary_table(spark, path)
    of_entry = lambda c: F.pmod(F.xxhash64(c), F.lit(batches))
    late = (F.pmod(F.xxhash64("CustLedgerEntryNo", "Amount"), F.lit(5)) == 0).cast("int")
    for batch in [*range(batches), batches, batches]:
        due = of_entry("CustLedgerEntryNo") + late
        due_now = led.details.where(due == batch)
        numbers = due_now.select(F.col("CustLedgerEntryNo").alias("EntryNo")).where(of_entry("EntryNo") < batch).distinct()
        old = X.entries_of(spark, sf_dir, numbers).where(of_entry("EntryNo") < batch)
        L.update_summary(table, batch, old, led.entries.where(of_entry("EntryNo") == batch), due_now)
    return led, table
