"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then joined filtering.

Each text gets its signals (mean word length, signs a word, share of repeated lines, share of repeated
words). Every (language, source) group keeps one KLL sketch a signal over the documents that the base
rule keeps; sketches are merged up to languages and to the whole corpus. A group of fewer than
``group_rows`` such documents takes its thresholds from its language, a language of fewer from the corpus.

A fence climbs the group's own high quantiles (``LADDER``). From a rung, the reach is ``width`` times
the rung's distance from the median beyond the rung; while the next rung lies within reach it is
climbed, and where the quantiles leap out of reach the fence stays at the last reach. So the
thin tail of a source moves its fence outwards, and a second mode of junk, be it 1 % or 20 % of
the source, does not. The lower fence descends the low quantiles likewise. Where a rung does not
differ from the median, or by less than one ``step`` of the signal, the step stands for the
distance. The thresholds, one row a group, are joined to the documents.

Defined results: null and empty texts have no words and fail the base rule; a null language or
source is a group of its own; where the base rule keeps no document of the table
there are no fences; equal rows get equal verdicts; an empty table gives no rows; other columns are not
read. Sketches are exact for some hundred documents and off by about 1/150 of the ranks at most beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, ship_package

from .text import BLANK_WORDS, Words, pieces, runs

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LINES = np.ones(256, dtype=bool)
LINES[10] = False
NOT_TAIL = (np.arange(256) & 0xC0) != 0x80
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
# signal: (value, step, has a lower fence)
SIGNALS = {
    "mean_word": ("word_chars / n_words", 0.25, True),
    "signs": ("n_symbols / n_words", 0.05, False),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.125, False),
    "repeats": ("n_repeat_words / n_words", 0.04, False),
}
#: Ranks that an upper fence climbs; a lower one descends their complements.
LADDER = (0.75, 0.9, 0.95, 0.98, 0.99, 0.995)
#: Sketch size: 400 keeps ranks within about 0.7 %.
SKETCH_K = 400


def _by_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def _repeated(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries equal to an earlier one of their row, entries equal to any other one of their row)."""
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    later, either = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    later[order[1:][same]] = True
    either[order[1:][same]] = True
    either[order[:-1][same]] = True
    return later, either


def measures(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(raw, offs, BLANK_WORDS, False)
    inside = BLANK_WORDS[raw]
    out = {"n_words": words.counts(), "word_chars": _by_row(inside & NOT_TAIL[raw], offs), "n_symbols": _by_row(SYMBOLS[raw], offs)}
    lines = Words(raw, offs, LINES, False)
    filled = np.concatenate([[0], np.cumsum(inside)])
    filled = filled[lines.end] > filled[lines.start]
    row = lines.row
    later, _ = _repeated(lines.hash[filled], row[filled])
    out["n_lines"] = np.bincount(row[filled], minlength=words.rows)
    out["n_dup_lines"] = np.bincount(row[filled][later], minlength=words.rows)
    at, h = runs(words.hash, words.first, 5)
    _, twice = _repeated(h, words.row[at])
    cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    out["n_repeat_words"] = _by_row(np.cumsum(cover)[:-1] > 0, words.first)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of every text."""

    def run(batches):
        for batch, raw, offs in pieces(batches, "text"):
            m = measures(raw, offs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(m[c], type=pa.int64()) for c in MEASURES]], names=["doc_id", "lang", "source", *MEASURES])

    ship_package(docs.sparkSession)
    cast = lambda c: F.col(c).cast("string").alias(c)
    return docs.select("doc_id", cast("lang"), cast("source"), cast("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{c} long" for c in MEASURES))


def climb(quantiles: Column, width: float, step: float, up: bool) -> Column:
    """The fence of [median, rung, …], rungs going outwards; null without quantiles."""
    sign = 1 if up else -1
    mid = quantiles[0]
    reach = lambda rung: rung + sign * width * F.greatest(sign * (rung - mid), F.lit(step))
    # once a rung is out of the fence's reach, so are all behind it
    return F.aggregate(quantiles, reach(mid), lambda fence, rung: F.when(sign * rung <= sign * fence, reach(rung)).otherwise(fence))


def fences(signals: DataFrame, group_rows: int, width: float) -> DataFrame:
    """lang, source and the fences of every group, from its own sketches or those of the next larger group; null signals are not counted."""
    sketch = [F.kll_sketch_agg_double(s, F.lit(SKETCH_K)).alias(s) for s in SIGNALS]
    groups = materialize(signals.groupBy("lang", "source").agg(F.count(next(iter(SIGNALS))).alias("n"), *sketch), "quality-sketches")
    merged = [F.kll_merge_agg_double(s, F.lit(SKETCH_K)).alias(s) for s in SIGNALS]
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    langs = langs.select(*[F.col(c).alias(f"l_{c}") for c in langs.columns])
    every = groups.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")))
    whole = groups.agg(F.sum("n").alias("n"), *merged)
    sides = [(s, up) for s, (_, _, lower) in SIGNALS.items() for up in ((True, False) if lower else (True,))]
    ranks = {up: F.array(F.lit(0.5), *[F.lit(r if up else round(1 - r, 6)) for r in LADDER]) for up in (True, False)}
    at = lambda c, up: F.kll_sketch_get_quantile_double(c, ranks[up])
    whole = whole.select(*[F.when(F.col("n") > 0, at(s, up)).alias(f"{s}_{up}") for s, up in sides]).first()
    g, ln = F.col("n") >= group_rows, F.col("l_n") >= group_rows
    out = [F.col("lang").alias("f_lang"), F.col("source").alias("f_source")]
    for s, up in sides:
        corpus = F.array(*[F.lit(v) for v in whole[f"{s}_{up}"] or []]).cast("array<double>")
        quantiles = F.when(g, at(s, up)).when(ln, at(f"l_{s}", up)).otherwise(corpus)
        out.append(climb(quantiles, width, SIGNALS[s][1], up).alias(f"{s}_{'high' if up else 'low'}"))
    return every.select(*out)


def judge(docs: DataFrame, group_rows: int = 200, width: float = 2.0) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and the names of the ``failed`` signals of every row of ``docs`` (doc_id, text, lang, source)."""
    rows = measure(docs).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = materialize(rows, "quality-measures")
    values = {s: F.when(F.col("n_words") > 0, F.expr(v)) for s, (v, _, _) in SIGNALS.items()}
    learnt = rows.filter("n_words > 0").select("lang", "source", *[F.when(~F.col("base_failed"), v).alias(s) for s, v in values.items()])
    limits = materialize(fences(learnt, group_rows, width), "quality-fences")
    rows = rows.withColumns(values).join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    out_of = [F.when((F.col(s) > F.col(f"{s}_high")) | ((F.col(s) < F.col(f"{s}_low")) if lower else F.lit(False)), F.lit(s)) for s, (_, _, lower) in SIGNALS.items()]
    rows = rows.withColumn("failed", F.filter(F.array(*out_of), lambda x: x.isNotNull()))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select("doc_id", "lang", "source", *MEASURES, "base_failed", "failed", "kept")
