"""One file out of many parts, written by the tasks at their own offsets.

The parts are cut into ranges. Where a part's bytes are kept, the lengths are known from the listing;
where they are transcoded, a first pass over the ranges (whole lines each) measures them. A prefix sum of
the lengths gives every range its place, and each task writes its ranges there, so the time is that of
the largest share and not of the whole file. The file grows under a temporary name in the target's folder
and is renamed when all ranges are written; a repeated task writes the same bytes to the same place.

Places can be written where a file system has offsets (a mounted folder that driver and executors
share). Object stores and HDFS have none: there ``merge_parts`` streams the parts through one process.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import arrow_fs, local_path, materialize, qualified, ship_package
from ..sources.ranges import BLOCK, line_blocks
from .fixed_width import list_parts, merge_parts, same_encoding

RANGES_SCHEMA = "part long, path string, start long, stop long"


def _range_bytes(f, start: int, stop: int, encoding: str | None):
    """The bytes that a range adds to the file, in blocks: as they are, or its whole lines transcoded."""
    if encoding is None:
        f.seek(start)
        while start < stop and (block := f.read(min(BLOCK, stop - start))):
            start += len(block)
            yield block
    else:
        for block in line_blocks(f, start, stop):
            yield block.decode("utf-8").encode(encoding)


def part_ranges(spark: SparkSession, folder: str, range_bytes: int) -> DataFrame:
    """``(part, path, start, stop)`` of the ranges of a folder's part files, one a partition; parts count in the order of their numbers."""
    rows = [(k, path, at, min(at + range_bytes, size)) for k, (path, size) in enumerate(list_parts(folder)) for at in range(0, size, range_bytes)]
    return spark.createDataFrame(rows, RANGES_SCHEMA).repartition(max(1, len(rows)))


def placed_ranges(ranges: DataFrame, first: int, encoding: str | None) -> DataFrame:
    """The ranges with the offset of their first byte in the file (``at``) and their length."""

    def measure(batches):
        for pdf in batches:
            sizes = []
            for path, start, stop in zip(pdf["path"], pdf["start"], pdf["stop"], strict=True):
                fs, local = arrow_fs(path)
                with fs.open_input_file(local) as f:
                    sizes.append(sum(len(b) for b in _range_bytes(f, start, stop, encoding)))
            yield pdf.assign(size=sizes)

    if encoding is None:
        sized = ranges.withColumn("size", F.col("stop") - F.col("start"))
    else:
        sized = ranges.mapInPandas(measure, f"{RANGES_SCHEMA}, size long")
    sized = materialize(sized, "part-sizes")
    before = Window.orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    placed = sized.withColumn("at", F.lit(first) + F.coalesce(F.sum("size").over(before), F.lit(0)))
    return materialize(placed, "part-places")


def assemble_parts(spark: SparkSession, folder: str, dest: str, drop_final_newline: bool = True, header: str | None = None,
                   encoding: str = "utf-8", range_bytes: int = 128 << 20) -> int:
    """The ``part-*`` files of ``folder`` as the single file ``dest``; the same bytes as ``merge_parts`` gives. Returns its length."""
    target = qualified(dest)
    if not target.startswith("file:"):
        merge_parts(folder, dest, drop_final_newline=drop_final_newline, header=header, encoding=encoding)
        fs, local = arrow_fs(target)
        return fs.get_file_info(local).size
    ship_package(spark)
    path = local_path(target)
    path = "/" + path.lstrip("/")
    growing = f"{path}.growing"
    head = b"" if header is None else (header + "\n").encode(encoding)
    other = None if same_encoding(encoding) else encoding
    places = placed_ranges(part_ranges(spark, folder, range_bytes), len(head), other)
    n, total = places.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(growing, "wb") as out:
        out.write(head)
        out.truncate(len(head) + total)

    def write(batches):
        for pdf in batches:
            done = []
            with open(growing, "r+b") as out:
                for source, start, stop, at in zip(pdf["path"], pdf["start"], pdf["stop"], pdf["at"], strict=True):
                    fs, local = arrow_fs(source)
                    out.seek(at)
                    with fs.open_input_file(local) as f:
                        done.append(sum(out.write(b) for b in _range_bytes(f, start, stop, other)))
                out.flush()
                os.fsync(out.fileno())
            yield pd.DataFrame({"bytes": done})

    written = places.repartition(max(1, n)).mapInPandas(write, "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if written != total:
        raise OSError(f"{written} of {total} bytes were written to {growing}")
    size = len(head) + total
    if drop_final_newline and total:
        with open(growing, "r+b") as out:
            out.seek(size - 1)
            if out.read(1) == b"\n":
                size -= 1
                out.truncate(size)
    os.replace(growing, path)
    return size
