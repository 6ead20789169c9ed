"""User-level entry points: the jobs a back-office user runs, end to end.

Each function reads tables or a landing folder, runs the Spark plan and writes its outputs to
shared storage (paths or catalog tables). Ledger inputs are the four ledger tables plus an
exclusion table; ``Ledger.from_catalog`` binds them by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import status as ST
from .operators.records import FileParams, payment_blocks, refund_totals
from .plans import jobs as JB
from .plans import refunds as RF
from .sinks import fixed_width as FW
from .sinks import tables as SK


@dataclass
class Ledger:
    accounts: DataFrame     # No, CustomerNo, AccountStatus
    customers: DataFrame    # No, FiscalCode, FullName, Name, VATRegistrationNo, CreateEnrichedXML, IndividualPerson
    entries: DataFrame      # EntryNo, CustomerNo, CustomerAccountNo, DocumentNo
    details: DataFrame      # CustLedgerEntryNo, Amount
    excluded: DataFrame     # CustomerNo

    @classmethod
    def from_catalog(cls, spark: SparkSession, accounts: str = "CustomerAccount", customers: str = "Customer",
                     entries: str = "CustLedgerEntry", details: str = "DetailedCustLedgEntry",
                     excluded: str = "ExcludedCustomer") -> "Ledger":
        return cls(spark.table(accounts), spark.table(customers), spark.table(entries), spark.table(details),
                   spark.table(excluded))


@dataclass
class RefundOutput:
    lines_path: str
    n_payments: int
    total_amount: str
    record_count: int
    movements_path: str | None = None


def _totals(numbered: DataFrame, amount: str) -> tuple[int, str, int]:
    t = refund_totals(numbered, amount).first()  # one aggregate row
    return int(t.n_payments), str(t.total_amount), int(t.record_count)


def domiciled_refund_file(ledger: Ledger, out_dir: str, params: FileParams,
                          movements_format: str = "parquet") -> RefundOutput:
    """Domiciled refunds: candidates → numbers → payment file; open documents with their payment keys
    as a reconciliation table (Parquet, or ``csv`` with header)."""
    run = RF.DomiciledRun(ledger, params, documents=True)
    path, mv_path = f"{out_dir}/payments", f"{out_dir}/movements"
    FW.sink_payment_blocks(run.blocks(), path)
    movements = run.movements()
    if movements_format == "csv":
        SK.sink_csv(movements, mv_path, sep=";", header=True)
    else:
        SK.sink_overwrite(movements, mv_path)
    return RefundOutput(path, *_totals(run.numbered(), "SaldoCliente"), mv_path)


def ordinary_refund_file(ledger: Ledger, out_dir: str, params: FileParams) -> RefundOutput:
    """Ordinary refunds per account (ties on the customer broken by account number)."""
    numbered, path = RF.ordinary_numbered(ledger), f"{out_dir}/payments"
    FW.sink_payment_blocks(payment_blocks(numbered, params, **RF.ordinary_layout()), path)
    return RefundOutput(path, *_totals(numbered, "SaldoFornitura"))


def unallocated_refund_file(credits: DataFrame, customers: DataFrame, out_dir: str, params: FileParams,
                            code: str = "Codice_Cliente", amount: str = "Avere") -> RefundOutput:
    """Unallocated payments: credits summed by upper-cased code, left-joined to customers,
    numbered before the 10..6000 filter (gaps kept); the trailer totals the raw credits."""
    kept = RF.unallocated_numbered(credits.select(F.col(code).alias("Codice_Cliente"), F.col(amount).alias("Avere")), customers)
    path = f"{out_dir}/payments"
    FW.sink_payment_blocks(payment_blocks(kept, params, **RF.unallocated_layout()), path)
    return RefundOutput(path, *_totals(kept, "Avere"))


def load_registry_files(spark: SparkSession, folder: str, target: str, load_ts: str, as_table: bool = False,
                        long_rows: str = "raise") -> DataFrame:
    """Distributor registry files → append to the registry table; returns the load metrics row."""
    return SK.load_with_metrics(spark, JB.registry_import(spark, folder, load_ts, long_rows), target, mode="append", as_table=as_table)


def load_supply_points(spark: SparkSession, archive_folder: str, extract_to: str, target: str,
                       load_ts: str, as_table: bool = False, long_rows: str = "drop") -> DataFrame:
    """Zipped supply-point registers → append to the register table; returns the load metrics row."""
    return SK.load_with_metrics(spark, JB.supply_point_import(spark, archive_folder, extract_to, load_ts, long_rows), target,
                                mode="append", as_table=as_table)


def load_prices(spark: SparkSession, folder: str, start: str, end: str, target: str, load_ts: str, as_table: bool = False) -> DataFrame:
    """Day-ahead price files of ``start``..``end`` → append (no de-duplication: re-loading a day doubles it)."""
    return SK.load_with_metrics(spark, JB.price_import(spark, folder, start, end, load_ts), target, mode="append", as_table=as_table)


def last_loaded_date(spark: SparkSession, target: str, column: str = "Data", as_table: bool = False) -> DataFrame:
    return (spark.table(target) if as_table else spark.read.parquet(target)).agg(F.max(column).alias("max_date"))


def load_offer_library(spark: SparkSession, sheet: DataFrame, name: str, target: str, as_table: bool = False) -> None:
    """Gas (name contains ``gas``) or electricity offer library → replace the table."""
    SK.sink_overwrite(JB.offer_library(sheet, name), target, as_table=as_table)


def load_offer_libraries(spark: SparkSession, folder: str, gas_target: str, electricity_target: str, sep: str = ";",
                         as_table: bool = False) -> dict[str, int]:
    """Every offer library of a folder → its table by file name; the number of files each table got."""
    return JB.offer_libraries(spark, folder, gas_target, electricity_target, sep, as_table)


def load_csv_table(spark: SparkSession, path: str, target: str, sep: str = ";", as_table: bool = False,
                   long_rows: str = "raise") -> tuple[bool, str]:
    """Any Latin-1 CSV → new all-string table with cleaned headers; fails (as a value) if it exists."""
    return JB.table_from_csv(spark, path, target, sep, as_table, long_rows)[1]


def replace_flow15(spark: SparkSession, folder: str, target: str, as_table: bool = False, long_rows: str = "raise") -> str:
    return JB.flow15_replace(spark, folder, target, as_table, long_rows)


def share(spark: SparkSession, target: str, sql: str | None = None, table: str | None = None,
          single_file: str | None = None) -> str:
    """Table or SQL result → ``;`` CSV with ``PDR`` identifiers zero-padded to 14 (one file if asked)."""
    return JB.share_export(spark, target, sql=sql, table=table, single_file=single_file)


def pipeline_status(runs: DataFrame, pipeline: str = "pipeline", ts: str = "ts", tie: str = "run_id",
                    status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Newest run status of each pipeline, and the group status rolled up over those."""
    latest = ST.latest_run(runs, pipeline, ts, tie, status)
    group = ST.status_rollup(latest.withColumn("__g", F.lit(1)), ["__g"], status=status, out="status").drop("__g")
    return latest, group


def write_bucketed_ledger(ledger: Ledger, location: str, buckets: int, prefix: str = "") -> Ledger:
    """Store entries and details bucketed (and sorted) on the entry key, as external catalog tables.

    The per-entry detail aggregate and the entries ⋈ detail-sums join then read co-partitioned
    buckets: no shuffle of the two largest tables on recurring runs. Accounts, customers and the
    exclusion list are small next to them and stay as they are.
    """
    spark = ledger.entries.sparkSession
    (ledger.entries.write.mode("overwrite").option("path", f"{location}/entries").bucketBy(buckets, "EntryNo")
     .sortBy("EntryNo").saveAsTable(f"{prefix}CustLedgerEntry"))
    (ledger.details.write.mode("overwrite").option("path", f"{location}/details")
     .bucketBy(buckets, "CustLedgerEntryNo").sortBy("CustLedgerEntryNo").saveAsTable(f"{prefix}DetailedCustLedgEntry"))
    return Ledger(ledger.accounts, ledger.customers, spark.table(f"{prefix}CustLedgerEntry"),
                  spark.table(f"{prefix}DetailedCustLedgEntry"), ledger.excluded)
