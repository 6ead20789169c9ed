"""Command line for the user jobs (``python -m tessera <job> ...`` or ``spark-submit -m``-style).

Ledger tables and other inputs are catalog table names or Parquet paths; outputs go to paths in
shared storage, or to catalog tables with ``--as-table``. Each command prints a one-line JSON summary.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from . import api
from .operators.records import FileParams
from .session import build_session, drop_scratch


def _df(spark, ref: str):
    """A catalog table name, or a path read as Parquet."""
    return spark.read.parquet(ref) if "/" in ref else spark.table(ref)


def _ledger(spark, a) -> api.Ledger:
    return api.Ledger(_df(spark, a.accounts), _df(spark, a.customers), _df(spark, a.entries), _df(spark, a.details),
                      _df(spark, a.excluded))


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="job", required=True)
    today = dt.date.today().isoformat()

    def refund(name):
        s = sub.add_parser(name)
        s.add_argument("--out", required=True)
        s.add_argument("--run-date", default=today)
        s.add_argument("--run-id", required=True)
        s.add_argument("--payer-name", default="")
        return s

    for name in ("domiciled", "ordinary"):
        s = refund(name)
        for t, d in (("accounts", "CustomerAccount"), ("customers", "Customer"), ("entries", "CustLedgerEntry"),
                     ("details", "DetailedCustLedgEntry"), ("excluded", "ExcludedCustomer")):
            s.add_argument(f"--{t}", default=d)
    s = refund("unallocated")
    s.add_argument("--credits", required=True)
    s.add_argument("--customers", default="Customer")
    for name, args in (("registry", ("folder", "target")), ("supply-points", ("folder", "extract-to", "target")),
                       ("prices", ("folder", "start", "end", "target")), ("csv-table", ("path", "target")),
                       ("flow15", ("folder", "target")), ("offer-libraries", ("folder", "gas-target", "electricity-target")),
                       ("share", ("target",))):
        s = sub.add_parser(name)
        for arg in args:
            s.add_argument(f"--{arg}", required=True)
        if name in ("registry", "supply-points", "prices"):
            s.add_argument("--load-ts", default=dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S"))
        if name in ("csv-table", "offer-libraries"):
            s.add_argument("--sep", default=";", choices=[";", ","])
        if name != "share":
            s.add_argument("--as-table", action="store_true", help="targets are catalog tables, not paths")
        if name in ("registry", "supply-points", "csv-table", "flow15"):
            s.add_argument("--long-rows", default="drop" if name == "supply-points" else "raise", choices=["raise", "drop"],
                           help="rows with more fields than their header")
        if name == "share":
            s.add_argument("--sql")
            s.add_argument("--table")
            s.add_argument("--single-file")
    a = p.parse_args(argv)

    spark = build_session(app_name=f"tessera-{a.job}")
    if a.job in ("domiciled", "ordinary", "unallocated"):
        params = FileParams(a.job, a.run_date, a.run_id, a.payer_name)
        if a.job == "domiciled":
            out = api.domiciled_refund_file(_ledger(spark, a), a.out, params)
        elif a.job == "ordinary":
            out = api.ordinary_refund_file(_ledger(spark, a), a.out, params)
        else:
            out = api.unallocated_refund_file(_df(spark, a.credits), _df(spark, a.customers), a.out, params)
        result = out.__dict__
    elif a.job == "registry":
        result = api.load_registry_files(spark, a.folder, a.target, a.load_ts, a.as_table, a.long_rows).first().asDict()
    elif a.job == "supply-points":
        result = api.load_supply_points(spark, a.folder, a.extract_to, a.target, a.load_ts, a.as_table, a.long_rows).first().asDict()
    elif a.job == "prices":
        result = api.load_prices(spark, a.folder, a.start, a.end, a.target, a.load_ts, a.as_table).first().asDict()
        result["max_date"] = str(api.last_loaded_date(spark, a.target, as_table=a.as_table).first().max_date)
    elif a.job == "csv-table":
        ok, message = api.load_csv_table(spark, a.path, a.target, a.sep, a.as_table, a.long_rows)
        result = {"ok": ok, "message": message}
    elif a.job == "flow15":
        result = {"message": api.replace_flow15(spark, a.folder, a.target, a.as_table, a.long_rows)}
    elif a.job == "offer-libraries":
        result = api.load_offer_libraries(spark, a.folder, a.gas_target, a.electricity_target, a.sep, a.as_table)
    else:
        result = {"written": api.share(spark, a.target, sql=a.sql, table=a.table, single_file=a.single_file)}
    print(json.dumps(result, default=str))
    drop_scratch(spark)  # outputs are written; the run's intermediates can go
    spark.stop()


if __name__ == "__main__":
    main()
