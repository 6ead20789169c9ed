"""Fixed-width payment records (120-character bank transfer lines) as column expressions.

Every record is one ``concat`` of constants, padded fields and blanks. A payment is seven lines
(10, 20, 30, 40, 60, 60, 70) keyed by (seq = payment number, sub = 1..7); the header is (0, 0)
and the trailer (max number + 1, 0). Ordering by (seq, sub) gives the file order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import alnum_code, numeric_code, unique_key_30
from ..functions.numbers import amount_cents
from ..functions.text import pad_left, pad_right, spaces

# Fixed values of the bank file layout.
SENDER_SERVICE = "PC14191"     # header: financial services code
RECEIVER = "60199"             # header and trailer: receiving bank
SENDER = "14191"               # trailer: sender
HEADER_TAG = ""                # header starts with one blank, no record type
TRAILER_TYPE = "EF"
TRANSFER_KIND = "48000"        # generic transfers
BANK_CODE = "07601"
CURRENCY = "E"
SEGMENT_1 = "SEG160"
SEGMENT_2 = "SEG260"
PAYER_FIELD = 30
NAME_FIELD = 90
COUNTER_WIDTH = 7
AMOUNT_WIDTH = 13
TOTAL_WIDTH = 15
LINES_PER_PAYMENT = 7
KEY_OFFSET = 56                # record 70: the key, then blanks to the end of the line
KEY_FIELD = 64


@dataclass(frozen=True)
class FileParams:
    """Run parameters of one payment file; codes are derived from ``run_id`` (deterministic)."""
    variant: str              # 'domiciled', 'unallocated' or 'ordinary'
    run_date: str             # yyyy-MM-dd
    run_id: str
    payer_name: str = ""

    @property
    def ordinary(self) -> bool:
        return self.variant == "ordinary"


def _d(params: FileParams, fmt: str) -> Column:
    return F.date_format(F.to_date(F.lit(params.run_date)), fmt)


def flow_code(params: FileParams) -> Column:
    """Flow id: 5 alphanumerics (ordinary) or ``BD-`` + 9 digits."""
    if params.ordinary:
        return alnum_code(params.run_id, F.lit("flow"), 5)
    return F.concat(F.lit("BD-"), numeric_code(params.run_id, F.lit("flow"), 9))


def line_code(params: FileParams) -> Column:
    """Code of record 10: the flow (ordinary) or ``BD-`` + 8 alnum + ``-`` + yyyyMMdd + 2 blanks (22 chars)."""
    if params.ordinary:
        return flow_code(params)
    return F.concat(F.lit("BD-"), alnum_code(params.run_id, F.lit("line"), 8), F.lit("-"), _d(params, "yyyyMMdd"),
                    spaces(2))


def _fitting(text: Column, width: int, what: str) -> Column:
    """``text``, or an error when it is wider than its field: a misaligned line is never written."""
    return F.when(F.length(text) > width, F.raise_error(F.concat(F.lit(f"{what} wider than {width} characters: "), text)).cast("string")).otherwise(text)


def _nr(nr) -> Column:
    number = F.col(nr).cast("string") if isinstance(nr, str) else nr.cast("string")
    return _fitting(pad_left(number, "0", COUNTER_WIDTH), COUNTER_WIDTH, "payment number")


def rec_head(params: FileParams) -> Column:
    blank = 89 if params.ordinary else 82
    return F.concat(spaces(1), F.lit(SENDER_SERVICE), F.lit(RECEIVER), _d(params, "ddMMyy"), flow_code(params),
                    spaces(blank), F.lit(CURRENCY), spaces(6))


def rec_10(params: FileParams, nr, amount, tax_id) -> Column:
    """Amount in cents (13), line code, then the fiscal code or VAT number (empty when unknown)."""
    return F.concat(spaces(1), F.lit("10"), _nr(nr), spaces(12), _d(params, "ddMMyy"), F.lit(TRANSFER_KIND),
                    _fitting(pad_left(amount_cents(amount), "0", AMOUNT_WIDTH), AMOUNT_WIDTH, "amount"), F.lit("+"), line_code(params),
                    F.lit(BANK_CODE), spaces(22), F.lit("3"), F.coalesce(_c(tax_id), F.lit("")), spaces(6),
                    F.lit(CURRENCY))


def rec_20(params: FileParams, nr) -> Column:
    if params.ordinary:
        return F.concat(spaces(1), F.lit("20"), _nr(nr), spaces(110))
    return F.concat(spaces(1), F.lit("20"), _nr(nr), pad_right(F.lit(params.payer_name), " ", PAYER_FIELD), spaces(80))


def rec_30(params: FileParams, nr, name=None) -> Column:
    if params.ordinary:
        return F.concat(spaces(1), F.lit("30"), _nr(nr), spaces(110))
    return F.concat(spaces(1), F.lit("30"), _nr(nr), pad_right(F.coalesce(_c(name), F.lit("")), " ", NAME_FIELD),
                    spaces(20))


def rec_40(params: FileParams, nr) -> Column:
    return F.concat(spaces(1), F.lit("40"), _nr(nr), spaces(110))


def rec_60(params: FileParams, nr) -> tuple[Column, Column]:
    """Two lines: segment 1 and segment 2."""
    blank = 100 if params.ordinary else 104
    return (F.concat(spaces(1), F.lit("60"), _nr(nr), F.lit(SEGMENT_1), spaces(blank)),
            F.concat(spaces(1), F.lit("60"), _nr(nr), F.lit(SEGMENT_2), spaces(blank)))


def payment_key(params: FileParams, key) -> Column:
    """Reconciliation key of record 70: customer + 00 + 20 alnum, or 30 alnum (ordinary)."""
    if params.ordinary:
        return alnum_code(params.run_id, _c(key), 30)
    return unique_key_30(params.run_id, _c(key))


def rec_70(params: FileParams, nr, key) -> Column:
    """The key field takes the 30 characters of a usual key and the blanks behind it, so longer customer codes keep the line at 120."""
    return F.concat(spaces(1), F.lit("70"), _nr(nr), spaces(46), _fitting(pad_right(payment_key(params, key), " ", KEY_FIELD), KEY_FIELD, "payment key"))


def rec_tail(params: FileParams, count, total, record_count) -> Column:
    blank = 21 if params.ordinary else 14
    return F.concat(spaces(1), F.lit(TRAILER_TYPE), F.lit(SENDER), F.lit(RECEIVER), _d(params, "ddMMyy"),
                    flow_code(params), spaces(blank), _nr(_c(count)), spaces(15),
                    _fitting(pad_left(amount_cents(_c(total)), "0", TOTAL_WIDTH), TOTAL_WIDTH, "total"),
                    _fitting(pad_left(_c(record_count).cast("string"), "0", COUNTER_WIDTH), COUNTER_WIDTH, "record count"), spaces(24), F.lit(CURRENCY),
                    spaces(6))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def payment_blocks(numbered: DataFrame, params: FileParams, nr: str, amount: str, tax_id: str | None,
                   name: str | None, key: str, total_of: str | None = None) -> DataFrame:
    """One row ``(seq, lines)`` per payment with its seven lines, and one each for header and trailer.

    ``total_of`` names the amount summed into the trailer (the rounded amount by default; the
    unallocated variant passes the raw one). Header and trailer come from one global aggregate row.
    """
    sixty_a, sixty_b = rec_60(params, nr)
    body_recs = [rec_10(params, nr, amount, tax_id if tax_id else F.lit(None).cast("string")),
                 rec_20(params, nr), rec_30(params, nr, name), rec_40(params, nr), sixty_a, sixty_b,
                 rec_70(params, nr, key)]
    body = numbered.select(F.col(nr).cast("bigint").alias("seq"), F.array(*body_recs).alias("lines"))
    totals = numbered.agg(F.count(F.lit(1)).alias("n"),
                          F.coalesce(F.sum(total_of or amount), F.lit(0)).alias("total"),
                          F.max(F.col(nr).cast("bigint")).alias("max_nr"))
    head = F.struct(F.lit(0).cast("bigint").alias("seq"), F.array(rec_head(params)).alias("lines"))
    tail = F.struct((F.coalesce(F.col("max_nr"), F.lit(0)) + 1).cast("bigint").alias("seq"),
                    F.array(rec_tail(params, F.col("n"), F.col("total"), F.col("n") * LINES_PER_PAYMENT + 2)).alias("lines"))
    frame = totals.select(F.explode(F.array(head, tail)).alias("r")).select("r.seq", "r.lines")
    return frame.unionByName(body)


def lines_of_blocks(blocks: DataFrame) -> DataFrame:
    """Rows ``(seq, sub, line)``: sub 1 to 7 within a payment, 0 for header and trailer."""
    sub = F.when(F.size("lines") == 1, 0).otherwise(F.col("pos") + 1).cast("int")
    return blocks.select("seq", "lines", F.posexplode("lines")).select("seq", sub.alias("sub"), F.col("col").alias("line"))


def payment_lines(numbered: DataFrame, params: FileParams, nr: str, amount: str, tax_id: str | None,
                  name: str | None, key: str, total_of: str | None = None) -> DataFrame:
    """Header, seven lines per payment and trailer as rows ``(seq, sub, line)``."""
    return lines_of_blocks(payment_blocks(numbered, params, nr, amount, tax_id, name, key, total_of))


def refund_totals(numbered: DataFrame, amount: str) -> DataFrame:
    """Payment count, total amount (as summed) and the physical record count ``7n + 2``."""
    return numbered.agg(F.count(F.lit(1)).alias("n_payments"),
                        F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,2)").alias("total_amount"),
                        (F.count(F.lit(1)) * LINES_PER_PAYMENT + 2).alias("record_count"))
