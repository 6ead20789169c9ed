"""Landing files derived by Spark from the driver tables, for the checked file-source queries.

The reference reads files dropped into a folder. The checked queries stage such files from the
given tables (so their size grows with the scale factor) into a fresh folder under the session's
shared checkpoint location, then run the real scan on them. Files are written by the tasks, one
or more per partition, so staging never funnels data through the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import qualified, scratch_path, ship_package


def write_text_files(df: DataFrame, dest: str, key_col: str, head_col: str, text_col: str,
                     name_fmt: str = "{key}_{tag}.csv", encoding: str = "UTF-8", tail: str | None = None) -> int:
    """In every partition, write one file per ``key_col`` value: its ``head_col`` text (one or more
    lines, same for all rows of the key), then the ``text_col`` lines of its rows, then ``tail``. Rows are
    streamed to the open files of the partition's keys. Returns rows written."""
    import uuid
    ship_package(df.sparkSession)
    dest = qualified(dest)
    call_tag = uuid.uuid4().hex[:8]  # one per call; file names are then fixed per partition

    def write(batches):
        from contextlib import ExitStack

        from pyspark import TaskContext
        from tessera.session import arrow_fs
        filesystem, root = arrow_fs(dest)
        filesystem.create_dir(root, recursive=True)
        # Same names on a task retry: a re-run overwrites its own files instead of adding copies.
        tag = f"{call_tag}_{TaskContext.get().partitionId():05d}"
        total = 0
        files: dict = {}
        with ExitStack() as open_files:
            for pdf in batches:
                for key, grp in pdf.groupby(key_col, sort=True):
                    if key not in files:
                        name = f"{root}/{name_fmt.format(key=key, tag=tag)}"
                        files[key] = open_files.enter_context(filesystem.open_output_stream(name, compression=None))
                        files[key].write((grp[head_col].iloc[0] + "\n").encode(encoding, "replace"))
                    files[key].write("".join(f"{t}\n" for t in grp[text_col]).encode(encoding, "replace"))
                    total += len(grp)
            if tail is not None:
                for f in files.values():
                    f.write((tail + "\n").encode(encoding, "replace"))
        yield pd.DataFrame({"n": [total]})
    res = df.select(key_col, head_col, text_col).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return int(res[0][0] or 0)


def fresh(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def stage_csv(df: DataFrame, dest: str, sep: str = ";", encoding: str = "ISO-8859-1", header: bool = True) -> str:
    (df.write.mode("overwrite").option("sep", sep).option("header", str(header).lower())
     .option("encoding", encoding).option("emptyValue", "").option("escape", '"').csv(dest))
    return dest
