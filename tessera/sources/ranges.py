"""Byte ranges of files: listing, packing into partitions, and the lines that start in a range.

Readers written in Python (data sources and ``mapInArrow`` scans) cut large files into ranges that
separate tasks read, and pack small files together, by the session's file-scan settings.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import InputPartition

from ..session import arrow_fs, qualified
from .frames import SUFFIX, FramedFile

BLOCK = 4 << 20
_STEP = 64 << 10


@dataclass(frozen=True)
class FileRange:
    path: str
    start: int
    stop: int
    inside: bool = False  # whether the first line that starts here begins inside quotes


@dataclass(frozen=True)
class Ranges(InputPartition):
    """What one task reads."""

    ranges: tuple[FileRange, ...]


def scan_options(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """Paths as Spark resolves them and the sizes of the session's file scans, as options of a data source."""
    size = lambda k: str(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(k)))
    paths = [path] if isinstance(path, str) else list(path)
    return {"paths": "\n".join(qualified(p) for p in paths), "maxpartitionbytes": size("spark.sql.files.maxPartitionBytes"),
            "opencost": size("spark.sql.files.openCostInBytes"), "parallelism": str(spark.sparkContext.defaultParallelism)}


@contextlib.contextmanager
def open_data(path: str):
    """The data of a file, open to be read from any place; those of a compressed file (``frames``) unpacked."""
    fs, local = arrow_fs(path)
    with fs.open_input_file(local) as f:
        yield FramedFile(f, f.size(), path) if path.endswith(SUFFIX) else f


def _data_size(path: str, size: int) -> int:
    if not path.endswith(SUFFIX):
        return size
    with open_data(path) as f:
        return f.size


def list_files(paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of all files at and below the paths, names that start with ``_`` or ``.`` left out; of a compressed file, the size of its data."""
    from pyarrow import fs as pafs
    out = []
    for path in paths:
        fs, local = arrow_fs(path)
        head = path[:len(path) - len(local)] if path.endswith(local) else ""
        info = fs.get_file_info(local)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(local, recursive=True))
        for f in found:
            below = f.path[len(local):].split("/")
            if f.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in below if p):
                out.append((head + f.path, _data_size(head + f.path, f.size)))
    return sorted(out)


def packed_ranges(files: list[tuple[str, int]], max_bytes: int, open_cost: int, parallelism: int, range_bytes: int | None = None) -> list[Ranges]:
    """Partitions of about equal work: long files cut, short ones together (a file's opening counts as ``open_cost`` bytes).

    ``range_bytes`` is the length at which files are cut where the caller fixes it. Then a task reads
    many ranges, four tasks a core at least, so tasks grow with the data and do not only get more.
    """
    if range_bytes is None:
        work = sum(size + open_cost for _, size in files)
        target = length = min(max_bytes, max(open_cost, work // max(1, parallelism)))
        again = open_cost  # what a further range of the same file costs
    else:
        length, again, open_cost = range_bytes, 0, min(open_cost, range_bytes)
        target = max(length, min(max_bytes, sum(size for _, size in files) // (4 * max(1, parallelism))))
    cut = [FileRange(path, at, min(at + length, size)) for path, size in files for at in range(0, size, length)]
    out, held, weight = [], [], 0
    for r in sorted(cut, key=lambda r: (r.start - r.stop, r.path, r.start)):
        cost = again if held and held[-1].path == r.path else open_cost
        if held and weight + r.stop - r.start > target:
            out.append(Ranges(tuple(held)))
            held, weight = [], 0
        held.append(r)
        weight += r.stop - r.start + cost
    return out + ([Ranges(tuple(held))] if held else [])


def partitions_of(options: dict) -> list[Ranges]:
    """The partitions of a data source with ``scan_options`` (and ``rangebytes``, where files are cut at a given length)."""
    fixed = int(options["rangebytes"]) if options.get("rangebytes") else None
    return packed_ranges(list_files(options["paths"].split("\n")), int(options["maxpartitionbytes"]), int(options["opencost"]), int(options["parallelism"]), fixed)


def step_size(at: int, stop: int, held: int, block: int) -> int:
    """How much to read next from place ``at`` of a range: what is left of it, or as much again as is held of a record that goes on."""
    return min(block, max(stop - at, held, _STEP))


def range_lines(f, start: int, stop: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(position, line without its end) of the lines of an open file that start at ``start`` or later and before ``stop``."""
    base, tail, skipping = max(0, start - 1), b"", start > 0
    f.seek(base)
    while data := f.read(step_size(base + len(tail), stop, len(tail), block)):
        data = tail + data
        at = 0
        if skipping:  # the line that began before the range belongs to the range before
            end = data.find(b"\n")
            if end < 0:
                base += len(data)
                continue
            at, skipping = end + 1, False
        while (end := data.find(b"\n", at)) >= 0:
            if base + at >= stop:
                return
            yield base + at, data[at:end].removesuffix(b"\r")
            at = end + 1
        if base + at >= stop:
            return
        base, tail = base + at, data[at:]
    if tail and not skipping and base < stop:
        yield base, tail.removesuffix(b"\r")


def line_blocks(f, start: int, stop: int, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes of the lines of an open file that start in the range, some whole lines at a time."""
    first = next(range_lines(f, start, stop, block), None)
    if first is None:
        return
    base = first[0]
    f.seek(base)
    data = b""
    while more := f.read(step_size(base + len(data), stop, len(data), block)):
        data += more
        last = stop - 1 - base  # the line that holds this place is the last one
        end = data.find(b"\n", last) + 1 if last < len(data) else 0
        if end:
            yield data[:end]
            return
        if last >= len(data):
            end = data.rfind(b"\n") + 1
            if end:
                yield data[:end]
                base, data = base + end, data[end:]
    if data:
        yield data
