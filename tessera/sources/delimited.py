"""Delimited files as a ranged data source: quoted line breaks, many headers and long rows in one scan.

Every task reads byte ranges and the first line of their files, so a file's columns are found by its
own titles whatever the other files' are. A field may hold line breaks: whether a range begins inside
quotes depends on all before it. So a first scan states for every range of a cut file how its quotes
end when it begins outside them and when it begins inside, and these two-valued functions are
composed along the file by a window. Records then belong to the range they begin in, and a file of
any size stays spread over many tasks. Only files that are cut need the first scan.

Blocks of whole records are parsed by Arrow's reader. A quote opens a field only at its start and is
written twice inside; one that is never closed raises. Titles hold no line breaks. Rows with more
fields than their titles raise, are dropped, or come with their text in ``LONG``; shorter rows have
nulls at their end.
"""

from __future__ import annotations

import csv
import dataclasses
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.csv as pa_csv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..session import arrow_fs, materialize, ship_package
from .ranges import BLOCK, FileRange, Ranges, line_blocks, list_files, open_data, partitions_of, range_lines, scan_options, step_size

FILE, LONG = "__file_name", "__raw_row"
STATES_SCHEMA = "path string, start long, after_outside int, after_inside int"
_CLOSE = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")')


@lru_cache
def _quoted(sep: bytes) -> re.Pattern:
    """A quoted field, closed or up to the end."""
    return re.compile(rb'(?:^|(?<=[\r\n' + re.escape(sep) + rb']))"[^"]*(?:""[^"]*)*("(?!")|\Z)')


def quoted_spans(data: bytes, inside: bool, sep: bytes) -> tuple[list[tuple[int, int]], bool]:
    """(spans of quoted text, whether the data end inside quotes) of data that begin at a line's start."""
    if b'"' not in data:
        return ([(0, len(data))], True) if inside else ([], False)
    spans, at = [], 0
    if inside:
        end = _CLOSE.match(data)
        if end is None:
            return [(0, len(data))], True
        at = end.end()
        spans.append((0, at))
    for m in _quoted(sep).finditer(data, at):
        spans.append(m.span())
        if not m.group(1):
            return spans, True
    return spans, False


def breaks(data: bytes, inside: bool, sep: bytes) -> np.ndarray:
    """Positions behind the line breaks outside quotes."""
    at = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    spans, _ = quoted_spans(data, inside, sep)
    if spans:
        edges = np.array(spans, dtype=np.int64)
        before = np.searchsorted(edges[:, 0], at, side="right") - 1
        at = at[(before < 0) | (at >= edges[before, 1])]
    return at + 1


def record_blocks(f, start: int, stop: int, inside: bool, sep: bytes, block: int = BLOCK) -> Iterator[bytes]:
    """Blocks of whole records of an open file: those that begin with a line that starts in the range.

    ``inside`` says whether the first such line begins inside quotes, so that its record began before.
    """
    first = next(range_lines(f, start, stop, block), None)
    if first is None:
        return
    base, data = first[0], b""
    f.seek(base)
    while more := f.read(step_size(base + len(data), stop, len(data), block)):
        data += more
        ends = breaks(data, inside, sep)
        if not len(ends):
            continue
        if inside:  # the rest of a record of the range before
            base, data, inside = base + int(ends[0]), data[ends[0]:], False
            if base >= stop:
                return
            ends = ends[1:] - ends[0]
            if not len(ends):
                continue
        k = int(np.searchsorted(ends, stop - base))  # the first record that begins behind the range
        if k < len(ends):
            yield data[:ends[k]]
            return
        yield data[:ends[-1]]
        base, data = base + int(ends[-1]), data[ends[-1]:]
    if quoted_spans(data, inside, sep)[1]:
        raise ValueError("a quote that is never closed")
    if data and not inside and base < stop:
        yield data


class StatesReader(DataSourceReader):
    """How the quotes of each range of a cut file end."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Ranges]:
        parts = partitions_of(self.options)
        cut = {r.path for p in parts for r in p.ranges if r.start > 0}
        return [Ranges(tuple(r for r in p.ranges if r.path in cut)) for p in parts if any(r.path in cut for r in p.ranges)]

    def read(self, partition: Ranges | None):
        sep = self.options["sep"].encode()
        for r in partition.ranges if partition else ():
            state = [False, True]
            with open_data(r.path) as f:
                for data in line_blocks(f, r.start, r.stop):
                    if b'"' in data:
                        state = [quoted_spans(data, s, sep)[1] for s in state]
            yield r.path, r.start, int(state[0]), int(state[1])


class QuoteStates(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quote_states"

    def schema(self) -> str:
        return STATES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StatesReader(self.options)


def inside_ranges(states: DataFrame) -> DataFrame:
    """``(path, start)`` of the ranges that begin inside quotes: the functions of the ranges before them, composed.

    Such a function keeps the state, swaps it, or gives the same state for both; so the state is that
    of the last range with a single outcome (outside, before the first range), swapped as often as the
    ranges since then do.
    """
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = ((F.col("after_outside") == 1) & (F.col("after_inside") == 0)).cast("int")
    states = states.withColumn("swaps", F.sum(swap).over(order))
    known = F.when(F.col("after_outside") == F.col("after_inside"), F.struct(F.col("after_outside").alias("state"), "swaps"))
    states = states.withColumns({"known": F.last(known, ignorenulls=True).over(before), "so_far": F.max("swaps").over(before)})
    since = F.coalesce("so_far", F.lit(0)) - F.coalesce("known.swaps", F.lit(0))
    return states.where((F.coalesce("known.state", F.lit(0)) + since) % 2 == 1).select("path", "start")


class DelimitedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Ranges]:
        parts = partitions_of(self.options)
        if not self.options.get("inside"):
            return parts
        import pyarrow.parquet as pq
        inside = set()
        for path, size in list_files([self.options["inside"]]):
            if size and path.endswith(".parquet"):
                fs, local = arrow_fs(path)
                inside |= {(r["path"], r["start"]) for r in pq.read_table(local, filesystem=fs).to_pylist()}
        return [Ranges(tuple(dataclasses.replace(r, inside=(r.path, r.start) in inside) for r in p.ranges)) for p in parts]

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        for path, ranges in itertools.groupby(partition.ranges if partition else (), key=lambda r: r.path):
            yield from self.read_ranges(path, ranges)

    def read_ranges(self, path: str, ranges: Iterable[FileRange]) -> Iterator[pa.RecordBatch]:
        """Some ranges of one file."""
        sep, encoding = self.options["sep"], self.options["encoding"]
        with open_data(path) as f:
            head = next(range_lines(f, 0, 1 << 62, 1 << 16), None)
            if head is None:
                return
            f.seek(len(head[1]))
            body = len(head[1]) + (2 if f.read(1) == b"\r" else 1)
            titles = split_header(head[1].decode(encoding), sep)
            if not titles:
                return
            try:
                for r in ranges:
                    if body < r.stop:
                        for block in record_blocks(f, max(r.start, body), r.stop, r.inside, sep.encode()):
                            yield from self.parse(block, titles, path)
            except ValueError as e:
                raise ValueError(f"{e} in {path}") from e

    def parse(self, block: bytes, titles: list[str], path: str) -> Iterator[pa.RecordBatch]:
        sep, encoding, policy = self.options["sep"], self.options["encoding"], self.options["longrows"]
        tokens = json.loads(self.options["tokens"])
        short: list[tuple[int, int, str]] = []
        long: list[str] = []

        def irregular(row) -> str:
            regular = row.number - 1 - len(short) - len(long)  # rows before it that have the right number of fields
            if row.actual_columns > row.expected_columns:
                long.append(row.text)
            else:
                short.append((regular, row.actual_columns, row.text))
            return "skip"

        def read(data: bytes, names: list[str], handler=None) -> pa.Table:
            return pa_csv.read_csv(
                pa.BufferReader(data), read_options=pa_csv.ReadOptions(column_names=names, block_size=len(data) + 1, use_threads=False),
                parse_options=pa_csv.ParseOptions(delimiter=sep, newlines_in_values=True, invalid_row_handler=handler),
                convert_options=pa_csv.ConvertOptions(column_types={t: pa.string() for t in names}, null_values=tokens, strings_can_be_null=bool(tokens)))

        table = read(block if encoding.upper().replace("-", "") == "UTF8" else block.decode(encoding).encode(), titles, irregular)
        if long and policy == "raise":
            raise ValueError(f"row with more fields than its header: {long[0]}")
        if short:
            table = self._with_short(table, short, titles, read)
        names = json.loads(self.options["titles"])
        name = path.rsplit("/", 1)[-1]
        extra = [FILE, LONG] if policy == "mark" else []
        nulls = lambda n: pa.nulls(n, pa.string())
        same = lambda n: pa.repeat(pa.scalar(name, type=pa.string()), n)
        for batch in table.combine_chunks().to_batches():
            own = dict(zip(titles, batch.columns, strict=True))
            cells = [own.get(t, None) for t in names]
            cells = [nulls(batch.num_rows) if c is None else c for c in cells]
            yield pa.RecordBatch.from_arrays(cells + ([same(batch.num_rows), nulls(batch.num_rows)] if extra else []), names=names + extra)
        if long and extra:
            yield pa.RecordBatch.from_arrays([*[nulls(len(long)) for _ in names], same(len(long)), pa.array(long, type=pa.string())], names=names + extra)

    def _with_short(self, table: pa.Table, short: list[tuple[int, int, str]], titles: list[str], read) -> pa.Table:
        """The table with its short rows in their places, filled up with nulls; those of one number of fields are read together."""
        tables, place = [table], []
        for n in sorted({n for _, n, _ in short}):
            own = [(at + k / (2 * len(short)), text) for k, (at, fields, text) in enumerate(short) if fields == n]
            more = read("".join(f"{text}\n" for _, text in own).encode(), titles[:n])
            tables.append(pa.table([*more.columns, *[pa.nulls(len(own), pa.string())] * (len(titles) - n)], names=titles))
            place += [at for at, _ in own]
        order = np.argsort(np.concatenate([np.arange(table.num_rows) + 0.5, place]), kind="stable")
        return pa.concat_tables(tables).take(pa.array(order))


class DelimitedRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delimited_ranges"

    def schema(self) -> T.StructType:
        names = json.loads(self.options["titles"]) + ([FILE, LONG] if self.options["longrows"] == "mark" else [])
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema) -> DataSourceReader:
        return DelimitedReader(self.options)


def split_header(line: str, sep: str) -> list[str]:
    """Titles of a header line (quotes respected)."""
    return next(csv.reader([line.lstrip("﻿")], delimiter=sep), [])


def scan_ranges(spark: SparkSession, path, titles: list[str], sep: str, encoding: str, tokens: list[str], long_rows: str,
                line_breaks: bool = True, range_bytes: int | None = None) -> DataFrame:
    """The columns ``titles`` of all files at ``path``, each read by its own header, as text.

    ``long_rows`` is raise, drop or mark (long rows come with their text in ``LONG`` and nulls elsewhere).
    With ``line_breaks`` off, fields are taken to hold none and large files are read once instead of twice.
    """
    ship_package(spark)
    options = {**scan_options(spark, path), "titles": json.dumps(titles), "tokens": json.dumps(tokens), "sep": sep, "encoding": encoding, "longrows": long_rows}
    if range_bytes:
        options["rangebytes"] = str(range_bytes)
    if line_breaks and any(r.start for p in partitions_of(options) for r in p.ranges):
        spark.dataSource.register(QuoteStates)
        inside = materialize(inside_ranges(spark.read.format("quote_states").options(**options).load()), "quote-states")
        options["inside"] = inside.inputFiles()[0].rsplit("/", 1)[0]
    spark.dataSource.register(DelimitedRanges)
    return spark.read.format("delimited_ranges").options(**options).load()
