"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source gets a target in words. Within a source, documents are grouped by a preference (by
default their length: very short and very long ones are preferred less), and the expected copies of a
document are proportional to its preference, at most ``most`` and such that the expected words reach
the target. The whole part of the expected copies is certain; the rest is an inclusion probability p. With
u uniform by a hash of the document, documents are ranked by [u / (1 - u)] / [p / (1 - p)] and taken
from the lowest on. The sample's size is fixed in words: taking stops before the document that would
pass what the target leaves, and the last place goes to the document nearest to the remaining gap.

The ranking is never sorted as a whole: word sums over fixed rank intervals find the interval in
which a source's quota ends, and only that interval is ordered. Tables joined to the documents have
one row a source and preference class; Spark broadcasts them when their size allows it and splits hot
sources otherwise.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; equal
rows are ranked in any order (they are interchangeable); an empty table gives no rows; a table without any word
gets targets of 0; ``carry`` columns are passed on, others are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

from .native import BLANK_WORD

INTERVALS = 4096


def fill(rows: DataFrame, by: Sequence[str], total: Column, weight: str, cap: str, to: str) -> DataFrame:
    """Shares ``to`` of ``total`` by weight within each group, none above its cap; what is cut off is shared again by weight.

    In the order of cap over weight the capped rows come first; the level of the others is the largest
    of the levels found by taking each prefix as capped.
    """
    group = [F.lit(1)] if not by else [F.col(c) for c in by]
    every = Window.partitionBy(*group)
    before = every.orderBy(F.col(cap) / F.col(weight)).rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum(weight).over(every) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    rows = rows.withColumn("_level", left / weights)
    return rows.withColumn(to, F.least(F.col(cap).cast("double"), F.max("_level").over(every) * F.col(weight))).drop("_level")


def length_preference(size: Column) -> Column:
    return F.when(size < 20, 0.5).when(size > 10_000, 0.75).otherwise(1.0)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 7, preference=length_preference,
        carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of ``docs`` (doc_id, text, source), with the ``carry`` columns.

    Sources in code-point order get ``weights`` in turn and share ``share`` times all words; no target
    exceeds ``most`` times its source's words and no document is taken more than ``most`` times.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(BLANK_WORD)).cast("long")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    sized = sized.withColumns({
        "pref": F.least(F.lit(8.0), F.greatest(F.lit(0.125), F.round(preference(F.col("size")) * 8) / 8)),
        "u": (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52),
        "row": F.monotonically_increasing_id(),
    })
    sized = materialize(sized, "mix-sized")

    classes = materialize(sized.groupBy("source", "pref").agg(F.sum("size").alias("words")), "mix-classes")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("weight", weight)  # one row a source
    sources = sources.withColumn("cap", F.col("source_size") * most)
    sources = fill(sources, [], share * F.sum("source_size").over(Window.partitionBy(F.lit(1))), "weight", "cap", "target").select("source", "source_size", "target")
    sources = materialize(sources, "mix-sources")

    plan = classes.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "pref", "words", "source_size", "target")
    plan = plan.withColumns({"cap": F.col("words") * most, "part": F.greatest(F.col("words"), F.lit(1)) * F.col("pref")})
    plan = fill(plan, ["source"], F.col("target"), "part", "cap", "due")
    expected = F.least(F.lit(float(most)), F.when(F.col("words") > 0, F.col("due") / F.col("words")).otherwise(0.0))
    plan = plan.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("int"))
    rest = F.col("expected") - F.col("whole")
    plan = plan.withColumn("p", F.when(rest > 1e-9, rest).otherwise(0.0))
    quota = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    plan = materialize(plan.select(F.col("source").alias("s"), F.col("pref").alias("g"), "source_size", "target", "whole", "p", quota.alias("quota")), "mix-plan")

    ranked = sized.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("pref") == F.col("g"))).drop("s", "g")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    drawn = (F.col("p") > 0) & (F.col("size") > 0)
    ranked = ranked.withColumn("rank", F.when(drawn, odds / (1 + odds)))
    ranked = ranked.withColumn("slot", F.floor(F.col("rank") * INTERVALS).cast("int"))
    narrow = ranked.filter("rank is not null").select("source", "slot", "rank", "doc_id", "size", "row", "quota")

    sums = narrow.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.max("quota").alias("quota"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("slot"))
    ends = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("quota") + 1e-6).groupBy("source").agg(F.min_by(F.struct("slot", (F.col("upto") - F.col("words")).alias("passed")), "slot").alias("e"))
    ends = materialize(ends.select(F.col("source").alias("s"), "e.slot", "e.passed").withColumnRenamed("slot", "end_slot"), "mix-ends")
    inside = narrow.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("end_slot")))
    sofar = F.col("passed") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    cuts = inside.withColumn("sofar", sofar).filter(F.col("sofar") > F.col("quota") + 1e-6).groupBy("source").agg(
        F.min(F.struct("sofar", "rank", "doc_id", "size", "row", "quota")).alias("c"))
    cuts = cuts.select(F.col("source").alias("s"), F.struct("c.rank", "c.doc_id", "c.size", "c.row").alias("cut"), (F.col("c.quota") - (F.col("c.sofar") - F.col("c.size"))).alias("gap"))
    cuts = materialize(cuts, "mix-cuts")

    place = F.struct("rank", "doc_id", "size", "row")
    behind = narrow.join(cuts, F.col("source").eqNullSafe(F.col("s"))).filter(place >= F.col("cut")).withColumn("off", F.abs(F.col("gap") - F.col("size")))
    last = behind.filter(F.col("off") < F.col("gap")).groupBy("source").agg(F.min(F.struct("off", "rank", "doc_id", "size", "row")).alias("l"))
    cuts = cuts.join(last.select("source", F.col("l.row").alias("last_row")), F.col("s").eqNullSafe(F.col("source")), "left").drop("source", "gap")
    cuts = materialize(cuts, "mix-last")

    out = ranked.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    before = F.col("cut").isNull() | (place < F.col("cut")) | F.coalesce(F.col("row") == F.col("last_row"), F.lit(False))
    out = out.withColumn("copies", (F.col("whole") + F.when(F.col("rank").isNotNull() & before, 1).otherwise(0)).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
                      *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)])
