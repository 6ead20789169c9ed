"""Benchmark decontamination over a distributed positional inverted index.

The corpus becomes a stored index cut by document into shards of bounded size (one row each): the
shard's test terms, their sorted word positions, and its documents. No document is split and no row
depends on another shard, so building and searching need no shuffle. Collection frequencies are
summed over the shards; a test window is searched from its rarest term on, each further list shifted
by its offset in the window and intersected with the starts that are left. Proximity matches ask the
rarest terms of a whole item to stand within a span of words, in any order.

The test set is the stated query set. Items of equal text are one item with several ids, and these
are cut into blocks of about ``block_bytes``, so what is shipped to the tasks is bounded; each block
is searched over the whole corpus. With several blocks the document rows are keyed and written first,
and the blocks' rows are merged on that key.

Defined results: a null or empty text has no words and no hits; an item without words matches
nothing; an item of fewer than ``n`` words is one window; repeated items and repeated document rows
are each counted for themselves (an item id that repeats counts once); an item without an id marks
words but is not listed; an empty test set leaves every document clean; other columns of either
table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, ship_package

from .text import ALNUM_WORDS, Words, column_bytes, pieces

INDEX_SCHEMA = "shard long, docs array<long>, n_words array<int>, terms array<long>, counts array<int>, positions binary"
MATCH_SCHEMA = ("doc_id long, n_words long, n_hit long, n_near long, items array<string>, near_items array<string>, "
                "spans array<struct<start:int,stop:int>>")
SHARD_BYTES = 2 << 20


def _item_blocks(items: DataFrame, block_bytes: int) -> int:
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.aggregate("ids", F.lit(0), lambda n, x: n + F.octet_length(x))), F.lit(0))).first()[0]
    return max(1, -(-int(size) // block_bytes))


class Windows:
    """The windows of one block of test items, as term numbers in a sorted vocabulary."""

    def __init__(self, rows: list, n: int):
        text = pa.array([r["text"] for r in rows], type=pa.string())
        raw, offs = column_bytes(text)
        words = Words(raw, offs, ALNUM_WORDS, True)
        self.vocabulary, term = np.unique(words.hash, return_inverse=True)
        self.names: list[list[str]] = [r["ids"] for r in rows]
        seen: dict[bytes, int] = {}
        self.windows: list[np.ndarray] = []
        self.owners: list[set[int]] = []
        self.items: list[np.ndarray] = []
        for i in range(len(rows)):
            t = term[words.first[i]:words.first[i + 1]]
            self.items.append(t)
            for s in range(max(1, len(t) - n + 1) if len(t) else 0):
                w = t[s:s + n]
                k = seen.setdefault(w.tobytes(), len(self.windows))
                if k == len(self.windows):
                    self.windows.append(w)
                    self.owners.append(set())
                self.owners[k].add(i)


def build_index(docs: DataFrame, vocabulary: np.ndarray, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shard rows of the documents' postings for the sorted ``vocabulary`` of term hashes."""

    def index(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch, raw, offs in pieces(batches, "text", shard_bytes):
            words = Words(raw, offs, ALNUM_WORDS, True)
            at = np.searchsorted(vocabulary, words.hash)
            at[at == len(vocabulary)] = 0
            position = np.flatnonzero(vocabulary[at] == words.hash) if len(vocabulary) else np.zeros(0, dtype=np.int64)
            order = np.argsort(at[position], kind="stable")
            position, term = position[order].astype(np.int32), at[position][order]
            terms, counts = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], type=pa.int64()),
                pa.array([batch.column(0).to_pylist()], type=pa.list_(pa.int64())),
                pa.array([words.counts()], type=pa.list_(pa.int32())),
                pa.array([terms], type=pa.list_(pa.int64())),
                pa.array([counts], type=pa.list_(pa.int32())),
                pa.array([position.tobytes()], type=pa.binary()),
            ], names=["shard", "docs", "n_words", "terms", "counts", "positions"])
            shard += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(index, INDEX_SCHEMA)


def _shifted(starts: np.ndarray, listed: np.ndarray, offset: int) -> np.ndarray:
    """The starts whose word at ``offset`` is in the sorted list."""
    at = np.searchsorted(listed, starts + offset)
    at[at == len(listed)] = len(listed) - 1
    return starts[listed[at] == starts + offset]


def _close(anchor: np.ndarray, listed: np.ndarray, first: np.ndarray, row: np.ndarray, span: int) -> np.ndarray:
    """Anchor positions that have a listed position of the same document within ``span`` words."""
    at = np.searchsorted(listed, anchor)
    left, right = listed[np.maximum(at - 1, 0)], listed[np.minimum(at, len(listed) - 1)]
    ok = np.zeros(len(anchor), dtype=bool)
    for near in (left, right):
        ok |= (np.abs(near - anchor) <= span) & (near >= first[row]) & (near < first[row + 1])
    return ok


def _search(win: Windows, frequency: np.ndarray, near_terms: int, near_span: int):
    order = [sorted(range(len(w)), key=lambda k, w=w: (frequency[w[k]], k)) for w in win.windows]
    rarest = np.array([w[o[0]] for w, o in zip(win.windows, order, strict=True)], dtype=np.int64)
    heads = [sorted({int(t) for t in item}, key=lambda t: (frequency[t], t))[:near_terms] for item in win.items]

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n_words = np.array(r["n_words"], dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(n_words)])
                ends = np.cumsum(r["counts"]) if r["counts"] else np.zeros(0, dtype=np.int64)
                flat = np.frombuffer(r["positions"], dtype=np.int32).astype(np.int64)
                lists = {t: flat[e - c:e] for t, c, e in zip(r["terms"], r["counts"], ends, strict=True)}
                rows = len(n_words)
                items: list[set[int]] = [set() for _ in range(rows)]
                near: list[set[int]] = [set() for _ in range(rows)]
                spans: list[list] = [[] for _ in range(rows)]
                present = np.zeros(len(win.vocabulary), dtype=bool)
                present[list(lists)] = True
                for k in np.flatnonzero(present[rarest]) if len(rarest) else ():
                    w = win.windows[k]
                    starts = lists[w[order[k][0]]] - order[k][0]
                    starts = starts[starts >= 0]
                    for o in order[k][1:]:
                        if not len(starts) or w[o] not in lists:
                            starts = starts[:0]
                            break
                        starts = _shifted(starts, lists[w[o]], o)
                    if not len(starts):
                        continue
                    row = np.searchsorted(first, starts, side="right") - 1
                    inside = starts + len(w) <= first[row + 1]
                    for s, d in zip(starts[inside], row[inside], strict=True):
                        items[d] |= win.owners[k]
                        spans[d].append((int(s - first[d]), int(s - first[d]) + len(w)))
                for i, head in enumerate(heads):
                    if len(head) < 2 or not all(t in lists for t in head):
                        continue
                    anchor = lists[head[0]]
                    row = np.searchsorted(first, anchor, side="right") - 1
                    ok = np.ones(len(anchor), dtype=bool)
                    for t in head[1:]:
                        ok &= _close(anchor, lists[t], first, row, near_span)
                    for d in set(row[ok].tolist()):
                        near[d].add(i)
                merged = [merge_spans(s) for s in spans]
                names = lambda s: sorted({x for i in s for x in win.names[i]})
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["docs"], type=pa.int64()),
                    pa.array(n_words, type=pa.int64()),
                    pa.array([sum(b - a for a, b in s) for s in merged], type=pa.int64()),
                    pa.array([len(names(s)) for s in near], type=pa.int64()),
                    pa.array([names(s) for s in items], type=pa.list_(pa.string())),
                    pa.array([names(s) for s in near], type=pa.list_(pa.string())),
                    pa.array([[{"start": a, "stop": b} for a, b in s] for s in merged], type=pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                ], names=["doc_id", "n_words", "n_hit", "n_near", "items", "near_items", "spans"])

    return search


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word intervals, as disjoint intervals in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_leaks(docs: DataFrame, bench: DataFrame, n: int = 10, near_terms: int = 4, near_span: int = 40,
               block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document row: words, words inside a test window, matched items, hit spans, and proximity matches.

    ``docs`` has doc_id and text, ``bench`` item_id and text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    items = materialize(bench.groupBy("text").agg(F.collect_set("item_id").alias("ids")), "leak-items")
    blocks = _item_blocks(items, block_bytes)
    if blocks > 1:
        docs = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("own_id"), "text"), "leak-rows")
        names = docs.select(F.col("_row").alias("doc_id"), "own_id")
        docs = docs.select(F.col("_row").alias("doc_id"), "text")
    found = []
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        win = Windows(part.collect(), n)  # about block_bytes of text and ids
        index = materialize(build_index(docs, win.vocabulary), "leak-index")
        frequency = np.zeros(len(win.vocabulary), dtype=np.int64)
        for t, c in index.select(F.explode(F.map_from_arrays("terms", "counts")).alias("t", "c")).groupBy("t").agg(F.sum("c")).collect():
            frequency[t] = c
        found.append(index.mapInArrow(_search(win, frequency, near_terms, near_span), MATCH_SCHEMA))
    if blocks == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ship = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    every = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), ship("items").alias("items"),
                                        ship("near_items").alias("near_items"), spans.alias("spans"))
    start = F.struct(F.lit(0).cast("int").alias("hit"), F.lit(0).cast("int").alias("end"))
    step = lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("hit"),
                                 F.greatest(a["end"], s["stop"]).alias("end"))
    every = every.join(names, "doc_id")
    return every.select(F.col("own_id").alias("doc_id"), "n_words", F.aggregate("spans", start, step, lambda a: a["hit"]).cast("long").alias("n_hit"),
                        F.size("near_items").cast("long").alias("n_near"), "items", "near_items", "spans")


def leak_digest(found: DataFrame) -> DataFrame:
    """The per-document digest columns of ``find_leaks``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "n_near")
