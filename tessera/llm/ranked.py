"""Ranked lexical search with bag deduplication.

The items are the stated query set, searched against all documents in blocks of a bounded size. Each
document is restricted to its bag, the counts of the block's terms in it, and its length is taken as
the step m of the score. Documents of equal bag and m have equal scores for every item: they are
hashed into classes (a class is told apart by the bag and m themselves, the hash only spreads them),
each class is scored once, and only its ``top`` smallest ids are carried, as no item can have more of
its members. Scoring keeps the best ``top`` documents of every item in each task; what is ranked
globally is at most that many rows an item and task.

Words are matched by 64-bit hashes; equal hashes are taken as equal words.

Defined results: a null text, or one without terms, does not count as a document; a document row
counts for itself, also when its id repeats; a document without an id ranks after equal scores with
one; every item row is answered for itself, and an item without terms has no rows; an empty
document table gives no rows; other columns of either table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, ship_package

from .text import ALNUM_WORDS, Words, column_bytes, pieces, ragged_index

BAG_SCHEMA = "doc_id long, n long, bag binary"
_PAIR = np.dtype([("term", "<i4"), ("tf", "<i4")])
_CELLS = 1 << 21


class Items:
    """The terms of one block of items: sorted term hashes, and for each term the items that have it and how often."""

    def __init__(self, rows: list):
        raw, offs = column_bytes(pa.array([r["text"] for r in rows], type=pa.string()))
        words = Words(raw, offs, ALNUM_WORDS, True)
        self.numbers = np.array([r["q"] for r in rows], dtype=np.int64)
        self.terms, term = np.unique(words.hash, return_inverse=True)
        pairs, self.times = np.unique(term * len(rows) + words.row, return_counts=True) if len(term) else (np.zeros(0, dtype=np.int64),) * 2
        self.item = pairs % max(1, len(rows))
        held = np.bincount(pairs // max(1, len(rows)), minlength=len(self.terms)).astype(np.int64)
        self.first, self.held = np.cumsum(held) - held, held


def bags(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n terms, bag) of every document with a term; a bag is its (term number, count) pairs in order of the terms."""

    def count(batches):
        for batch, raw, offs in pieces(batches, "text"):
            words = Words(raw, offs, ALNUM_WORDS, True)
            at = np.searchsorted(terms, words.hash)
            at[at == len(terms)] = 0
            hit = np.flatnonzero(terms[at] == words.hash) if len(terms) else np.zeros(0, dtype=np.int64)
            pairs, tf = np.unique(words.row[hit] * len(terms) + at[hit], return_counts=True)
            flat = np.empty(len(pairs), dtype=_PAIR)
            flat["term"], flat["tf"] = pairs % max(1, len(terms)), tf
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(terms))
            bag = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((ends * _PAIR.itemsize).astype(np.int32)), pa.py_buffer(flat)])
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts(), type=pa.int64()), bag], names=["doc_id", "n", "bag"])
            yield out.filter(pa.array(words.counts() > 0))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(count, BAG_SCHEMA)


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all pairs of the bags in order, number of pairs of each)."""
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[o[0]:o[-1]].view(_PAIR) if o[-1] > o[0] else np.zeros(0, dtype=_PAIR)
    return flat, np.diff(o) // _PAIR.itemsize


def document_frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """Number of documents that hold each term; one partial count a term and task is shuffled."""

    def count(batches):
        held = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            held += np.bincount(_pairs(batch.column(0))[0]["term"], minlength=terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "df"])

    df = np.zeros(terms, dtype=np.int64)
    for r in found.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the block
        df[r["term"]] = r["df"]
    return df


class Best:
    """The best documents of each item seen so far in a task."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items, dtype=np.int64)
        self.rows = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, score, no id, id

    def add(self, item: np.ndarray, score: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        rows = [np.concatenate(p) for p in zip(self.rows, (item, score, none, doc), strict=True)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        first = np.searchsorted(rows[0], rows[0])
        rank = np.arange(len(order)) - first
        full = rank == self.top - 1
        self.least[rows[0][full]] = rows[1][full]
        self.rows = [r[rank < self.top] for r in rows]


def score_classes(classes: DataFrame, items: Items, weight: np.ndarray, top: int) -> DataFrame:
    """(q, score, doc_id): in each task the best documents of every item, each class scored once."""

    def score(batches):
        n_items = len(items.numbers)
        best = Best(n_items, top)
        for batch in batches:
            flat, sizes = _pairs(batch.column(0))
            m = np.repeat(batch.column(1).to_numpy(), sizes)
            tf = flat["tf"].astype(np.int64)
            part = weight[flat["term"]] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            work = np.concatenate([[0], np.cumsum(items.held[flat["term"]])])[ends]
            ids = batch.column(2)
            id_first, id_all = ids.offsets.to_numpy().astype(np.int64), ids.values
            lo = 0
            while lo < batch.num_rows:  # some classes at a time: bounded cells and bounded terms with their items
                hi = int(np.searchsorted(work, work[lo] + _CELLS, side="right")) - 1
                hi = max(lo + 1, min(hi, lo + max(1, _CELLS // n_items), batch.num_rows))
                a, b = ends[lo], ends[hi]
                term = flat["term"][a:b]
                held = items.held[term]
                at = ragged_index(items.first[term], held)
                row = np.repeat(np.repeat(np.arange(hi - lo), sizes[lo:hi]), held)
                cells = np.zeros((hi - lo) * n_items, dtype=np.int64)
                np.add.at(cells, row * n_items + items.item[at], np.repeat(part[a:b], held) * items.times[at])
                cells = cells.reshape(hi - lo, n_items)
                cls, item = np.nonzero((cells > 0) & (cells >= best.least))
                if len(cls):
                    n = np.diff(id_first)[lo + cls]
                    doc = id_all.take(pa.array(ragged_index(id_first[lo + cls], n)))
                    best.add(np.repeat(item, n), np.repeat(cells[cls, item], n), np.asarray(doc.is_null().to_numpy(zero_copy_only=False), dtype=np.int64), doc.fill_null(0).to_numpy())
                lo = hi
        item, points, none, doc = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(items.numbers[item]), pa.array(points), pa.array(doc, mask=none.astype(bool))], names=["q", "score", "doc_id"])

    return classes.select("bag", "m", "ids").mapInArrow(score, "q long, score long, doc_id long")


def search(docs: DataFrame, bench: DataFrame, top: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` best documents of every item; equal scores by ascending doc_id.

    ``docs`` has doc_id and text, ``bench`` item_id and text. Equal item texts are searched once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bench = bench.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    texts = materialize(bench.select("text").distinct().withColumn("q", F.monotonically_increasing_id()), "ranked-items")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    found = []
    for b in range(blocks):
        items = Items((texts if blocks == 1 else texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)).collect())  # about block_bytes of text
        if not len(items.terms):
            continue
        bag = materialize(bags(docs, items.terms), "ranked-bags")
        n, total = bag.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n:
            continue
        df = document_frequencies(bag, len(items.terms))
        weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        own = bag.filter(F.octet_length("bag") > 0).select("doc_id", "bag", F.expr(f"25 + (75L * n * {n}L) div {total}L").alias("m"))
        same = ["hash", "m", "bag"]
        place = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))
        members = own.withColumn("hash", F.xxhash64("bag", "m")).withColumn("place", place).filter(F.col("place") <= top)
        ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"])  # at most top
        classes = materialize(members.groupBy(*same).agg(ids.alias("ids")), "ranked-classes")
        found.append(score_classes(classes, items, weight, top))
    if not found:
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        return bench.filter("false").select("item_id", none("rank", "int"), none("doc_id", "long"), none("score", "long"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(texts, "q").join(bench, "text").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
