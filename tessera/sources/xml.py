"""XML row files: children of the root become rows, child elements become columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_xml_rows(spark: SparkSession, path, row_tag: str = "Prezzi", drop: tuple = ("id", "Mercato"),
                  all_strings: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``row_tag`` elements (the schema node of the file is not a row); ``drop`` columns removed.

    ``path`` is a folder or a list of files; only they are opened. The columns are found in those files, unless ``columns``
    declares them, which saves that pass. ``all_strings`` keeps every value as text (decimal commas are converted later, by column).
    """
    reader = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false" if all_strings else "true")
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    df = reader.load(path)
    return df.drop(*[c for c in drop if c in df.columns])
