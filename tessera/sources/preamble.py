"""Registry files with a preamble line: ``company;zone;…;vat``, then the real header, then rows.

A Python data source reads byte ranges: a large file is spread over many tasks, small ones are read
together, and every task reads the first two lines of the files it has ranges of. So preamble and
titles come with the rows, known by their position, and no row is joined to its file or compared
with a title. Rows are parsed as quoted CSV and read by their own file's titles: files whose columns
move between months load by name. Quoted line breaks are not supported. A row with more fields than
its header raises or is dropped, never cut; a shorter one has nulls at its end.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..session import ship_package
from .csv import LONG_ROWS
from .ranges import FileRange, Ranges, open_data, partitions_of, range_lines, scan_options

ROWS_SCHEMA = "file_name string, company string, zone string, vat string, line_no long, header array<string>, values array<string>"
_BATCH = 4096


def split_fields(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep), []) if '"' in line else line.split(sep)


class Head:
    """The preamble and the titles of a file, and where its rows begin (None for a file without two lines)."""

    def __init__(self, f, path: str, sep: str, encoding: str, keys: Callable[[list[str]], list[str]] | None):
        lines = range_lines(f, 0, 1 << 62, 1 << 16)
        first, second = next(lines, None), next(lines, None)
        self.body = None
        if second is None:
            return
        f.seek(second[0] + len(second[1]))
        self.body = second[0] + len(second[1]) + (2 if f.read(1) == b"\r" else 1)
        self.preamble = split_fields(first[1].decode(encoding).lstrip("﻿"), sep)
        titles = split_fields(second[1].decode(encoding), sep)
        self.titles = keys(titles) if keys else titles
        if len(set(self.titles)) < len(self.titles):
            raise ValueError(f"titles that stand twice in {path}")


class PreambleReader(DataSourceReader):
    def __init__(self, options: dict, keys: Callable[[list[str]], list[str]] | None):
        self.options, self.keys = dict(options), keys

    def partitions(self) -> list[Ranges]:
        return partitions_of(self.options)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from self.read_range(r)

    def read_range(self, r: FileRange) -> Iterator[pa.RecordBatch]:
        sep, encoding = self.options["sep"], self.options["encoding"]
        wanted = self.options["wanted"].split("\n") if self.options.get("wanted") else None
        with open_data(r.path) as f:
            head = Head(f, r.path, sep, encoding, self.keys)
            if head.body is None or head.body >= r.stop:
                return
            n = len(head.titles)
            where = {t: i for i, t in enumerate(head.titles)}
            places = None if wanted is None else [where.get(w, n) for w in wanted]  # the n-th field is null

            def rows() -> Iterator[tuple[int, list]]:
                for at, raw in range_lines(f, max(r.start, head.body), r.stop):
                    if not raw:
                        continue
                    fields = split_fields(raw.decode(encoding), sep)
                    if len(fields) > n:
                        if self.options["longrows"] == "raise":
                            raise ValueError(f"row with more fields than its header in {r.path}: {raw.decode(encoding)}")
                        continue
                    fields += [None] * (n + 1 - len(fields))
                    yield at, fields[:n] if places is None else [fields[i] for i in places]

            pre = [*head.preamble, None]
            constant = [r.path.rsplit("/", 1)[-1], pre[0], pre[1], head.preamble[-1]]
            held: list[tuple[int, list]] = []
            for row in rows():
                held.append(row)
                if len(held) == _BATCH:
                    yield self._batch(constant, head.titles, held)
                    held = []
            if held:
                yield self._batch(constant, head.titles, held)

    def _batch(self, constant: list, titles: list[str], rows: list[tuple[int, list]]) -> pa.RecordBatch:
        n, names = len(rows), ["file_name", "company", "zone", "vat", "line_no", "header", "values"]
        strings = pa.list_(pa.string())
        same = lambda v, t: pa.repeat(pa.scalar(v, type=t), n)
        return pa.RecordBatch.from_arrays([
            *[same(c, pa.string()) for c in constant], pa.array([at for at, _ in rows], type=pa.int64()),
            same(titles, strings), pa.array([v for _, v in rows], type=strings)], names=names)


def _source(keys: Callable[[list[str]], list[str]] | None) -> type[DataSource]:
    class PreambleCsv(DataSource):
        @classmethod
        def name(cls) -> str:
            return "preamble_csv" if keys is None else f"preamble_csv_{keys.__name__}"

        def schema(self) -> str:
            return ROWS_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return PreambleReader(self.options, keys)

    return PreambleCsv


def scan_preamble_rows(spark: SparkSession, path, sep: str = ";", encoding: str = "UTF-8",
                       header_keys: Callable[[list[str]], list[str]] | None = None, long_rows: str = "raise",
                       wanted: list[str] | None = None) -> DataFrame:
    """``(file_name, company, zone, vat, line_no, header, values)`` for every body row.

    ``header_keys`` may rewrite a file's titles. With ``wanted`` titles, ``values`` has one entry for
    each of them in that order (their positions are found once a file range, null where the file lacks
    the title); else the fields in file order, as many as titles. ``line_no`` is the row's byte
    position: it orders the rows of a file.
    """
    if long_rows not in LONG_ROWS[:2]:
        raise ValueError("long_rows is 'raise' or 'drop' for registry files")
    ship_package(spark)
    source = _source(header_keys)
    spark.dataSource.register(source)
    options = {**scan_options(spark, path), "sep": sep, "encoding": encoding, "longrows": long_rows, "wanted": "\n".join(wanted or [])}
    return spark.read.format(source.name()).options(**options).load()


def scan_preamble_csv(spark: SparkSession, path, sep: str = ";", encoding: str = "UTF-8",
                      header_keys: Callable[[list[str]], list[str]] | None = None, long_rows: str = "raise") -> DataFrame:
    """Rows ``(file_name, company, zone, vat, line_no, fields map)``; ``header_keys`` may rewrite a file's
    titles before they become the map keys. A header-only file gives no rows."""
    rows = scan_preamble_rows(spark, path, sep, encoding, header_keys, long_rows)
    return rows.select("file_name", "company", "zone", "vat", "line_no", F.map_from_arrays("header", "values").alias("fields"))


def field(name: str) -> Column:
    """Value of a header title in the row's map (null when this file lacks the column)."""
    return F.col("fields").getItem(name)
