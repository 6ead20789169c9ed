"""Join helpers: left join with suffixes, lookup with fallback. Spark picks the strategy from measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def left_join_suffixed(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                       rsuffix: str = "cliente_") -> DataFrame:
    """Left join keeping unmatched left rows; right columns that clash with left names get ``rsuffix``.

    Duplicated right keys fan out (one output row per match). The right key column is dropped.
    """
    renames = {c: (c + rsuffix if c in left.columns else c) for c in right.columns if c != right_key}
    r = right.select(F.col(right_key).alias("__rkey"), *[F.col(c).alias(n) for c, n in renames.items()])
    return left.join(r, left[left_key] == r["__rkey"], "left").drop("__rkey")


def lookup_fallback(df: DataFrame, key: str, mapping: DataFrame, map_key: str, map_value: str,
                    out: str) -> DataFrame:
    """``out`` = mapped value of ``key``; an unmatched key is kept as is (pandas ``Series.replace``)."""
    m = mapping.select(F.col(map_key).alias("__mk"), F.col(map_value).alias("__mv"))
    return (df.join(m, df[key] == m["__mk"], "left")
            .withColumn(out, F.coalesce(F.col("__mv"), F.col(key)))
            .drop("__mk", "__mv"))


def semi_listing(names: DataFrame, listing: DataFrame, name_col: str, listing_col: str) -> DataFrame:
    """Keep generated names that are present in a listing (``LEFT SEMI``)."""
    return names.join(listing, names[name_col] == listing[listing_col], "left_semi")
