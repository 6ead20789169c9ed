"""Ordered text output of payment lines and reading it back.

The write range-partitions on the file order and sorts inside each partition, so part files
``part-00000…`` are in file order and no single task holds the file. Whole payments are shuffled and
become their lines in the write task. The number of parts follows the data (adaptive coalescing)
unless it is given. ``merge_parts`` concatenates the parts into one file outside Spark (streamed,
never loaded whole; one process, so its time grows with the file); ``assemble.assemble_parts`` lets the
tasks write it where the file system has offsets.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import KEY_FIELD, KEY_OFFSET, lines_of_blocks


def sink_payment_blocks(blocks: DataFrame, target: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """Write ``(seq, lines)`` rows as an ordered text file of many parts."""
    ranged = blocks.repartitionByRange(partitions, "seq") if partitions else blocks.repartitionByRange("seq")
    lines_of_blocks(ranged.sortWithinPartitions("seq")).select("line").write.mode(mode).text(target)


def sink_fixed_width(lines: DataFrame, target: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """Write ``(seq, sub, line)`` rows as an ordered text file of many parts."""
    ranged = lines.repartitionByRange(partitions, "seq", "sub") if partitions else lines.repartitionByRange("seq", "sub")
    ranged.sortWithinPartitions("seq", "sub").select("line").write.mode(mode).text(target)


def scan_fixed_width(spark: SparkSession, path: str, prefix: str = " 70", offset: int = KEY_OFFSET,
                     length: int = KEY_FIELD) -> DataFrame:
    """Keys of the lines starting with ``prefix``: the field of ``length`` characters at 0-based ``offset``, without its trailing blanks."""
    text = spark.read.text(path)
    return (text.where(F.col("value").startswith(prefix))
            .select(F.rtrim(F.substring("value", offset + 1, length)).alias("CodiceUnivoco")))


def part_number(name: str) -> tuple[int, str]:
    """Order of part files: by their number (names as text go wrong from 100,000 parts on)."""
    found = re.match(r"part-(\d+)", name)
    return (int(found[1]) if found else -1, name)


def list_parts(folder: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's ``part-*`` files in the order of their numbers."""
    from pyarrow import fs as pafs

    from ..session import arrow_fs, qualified
    whole = qualified(folder).rstrip("/")
    fs, root = arrow_fs(whole)
    found = [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and i.base_name.startswith("part-")]
    return [(f"{whole}/{i.base_name}", i.size) for i in sorted(found, key=lambda i: part_number(i.base_name))]


def same_encoding(encoding: str) -> bool:
    """Whether text parts (UTF-8) keep their bytes."""
    import codecs
    return codecs.lookup(encoding).name == "utf-8"


def merge_parts(folder: str, dest: str, drop_final_newline: bool = True, chunk: int = 8 << 20,
                header: str | None = None, encoding: str = "utf-8") -> None:
    """Concatenate the ``part-*`` files of ``folder`` in the order of their numbers into the single file ``dest``
    (the bank file), streaming fixed-size chunks; works on any filesystem pyarrow can open.
    ``header`` (one line, no newline) is written first, e.g. for CSV parts written without one.
    ``encoding`` transcodes the UTF-8 parts (e.g. ``latin-1`` so each record's byte width equals
    its character width); a character that does not exist in it raises.
    """
    import codecs

    from ..session import arrow_fs, qualified
    dst_fs, dst = arrow_fs(qualified(dest))
    parts = [arrow_fs(p) for p, _ in list_parts(folder)]
    same = same_encoding(encoding)
    decoder = codecs.getincrementaldecoder("utf-8")()

    def recode(block: bytes, final: bool = False) -> bytes:
        return block if same else decoder.decode(block, final).encode(encoding)

    last = b""
    with dst_fs.open_output_stream(dst, compression=None) as out:
        if header is not None:
            out.write((header + "\n").encode(encoding))
        for src_fs, p in parts:
            with src_fs.open_input_stream(p, compression=None) as fh:
                while True:
                    block = fh.read(chunk)
                    if not block:
                        break
                    if last:
                        out.write(recode(last))
                    last = block
        if drop_final_newline and last.endswith(b"\n"):
            last = last[:-1]
        out.write(recode(last, final=True))
