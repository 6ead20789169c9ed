"""Language-model scores by a weighted backoff automaton.

The model is a bigram model of words, smoothed with add-one unigrams: P(w | h) = b c(h, w) / c(h) +
(1 - b) P(w) with b = c(h) / (c(h) + prior). As an automaton every history is a state, every seen bigram an arc
that carries log P(w | h), and a failure arc with weight log(1 - b) leads to the root, whose arcs are
the unigrams. A text is read once from left to right, from the state of a text's end to its end.

Counts cover every training text and live in no single place. Texts are packed into written chunks
of bounded size (their distinct words, and each text as numbers of them). Each chunk sends its
distinct words and bigrams with its own training counts to the hash range they belong to, as sorted
packed lists; each range adds them up and answers every chunk with the totals of what it sent. A
chunk then builds the parts of the automaton its texts can reach and reads them. A frequent n-gram is
one entry a chunk, and ranges are as many as their entries ask for.

Defined results: a null text is empty, that is, its end alone; a row with a null id is not learnt
from and counts as held out; equal rows get equal scores; without training texts all counts are 0
and every token has the unigram probability of an unknown word; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, ship_package

from .graph import free_shuffles
from .text import BLANK_WORDS, Words, mix, pieces

END = mix(np.array([0x5EED], dtype=np.uint64))[0]
CHUNKS = "chunk long, docs array<long>, train array<boolean>, lengths array<int>, words binary, stream binary"
SENT = "bucket int, chunk long, kind int, keys binary, counts binary"
TOTALS = "chunk long, bucket int, kind int, totals binary, tokens long, types long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: Entries a hash range should hold.
RANGE_ENTRIES = 1_500_000
#: Tokens one automaton is built for (or one text, if that is longer).
READ_TOKENS = 100_000


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as gaps of the fewest bytes that hold them all."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    gaps = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, data[0])
    out = np.zeros((len(gaps) + 1, 8), dtype=np.uint8)
    out[0] = np.frombuffer(data, dtype=np.uint8, count=8, offset=1)
    out[1:, :data[0]] = gaps
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def _chunks(chunk_bytes: int):
    def flush(number: int, held: list) -> pa.RecordBatch:
        docs, train, counts, hashes = (np.concatenate(x) if i > 1 else [v for y in x for v in y] for i, x in enumerate(zip(*held, strict=True)))
        ends = np.cumsum(counts)
        tokens = np.insert(hashes, ends, END)
        words, stream = np.unique(tokens, return_inverse=True)
        return pa.RecordBatch.from_arrays([
            pa.array([number], type=pa.int64()), pa.array([docs], type=pa.list_(pa.int64())), pa.array([train], type=pa.list_(pa.bool_())),
            pa.array([counts + 1], type=pa.list_(pa.int32())), pa.array([words.tobytes()], type=pa.binary()), pa.array([_pack(stream.astype(np.uint32))], type=pa.binary()),
        ], names=["chunk", "docs", "train", "lengths", "words", "stream"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch, raw, offs in pieces(batches, "text"):
            words = Words(raw, offs, BLANK_WORDS, True)
            held.append((batch.column(0).to_pylist(), batch.column(1).to_pylist(), words.counts(), words.hash))
            size += len(raw) + 64 * batch.num_rows
            if size >= chunk_bytes:
                yield flush(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield flush(number, held)

    return run


class Chunk:
    """The n-grams of one chunk's texts: sorted keys, training counts, and the n-gram of each token."""

    def __init__(self, row: dict):
        self.number, self.docs, self.train = row["chunk"], row["docs"], np.array(row["train"], dtype=bool)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.words = np.frombuffer(row["words"], dtype=np.uint64)
        self.stream = _unpack(row["stream"], np.uint32)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.end = int(np.searchsorted(self.words, END))
        self.before = np.empty_like(self.stream)
        self.before[1:] = self.stream[:-1]
        self.before[self.first[:-1]] = self.end
        learnt = np.repeat(self.train, self.lengths)
        self.pairs, self.pair = np.unique(mix(self.words[self.before] * np.uint64(0x9FB21C651E98DF25) + self.words[self.stream]), return_inverse=True)
        self.word_counts = np.bincount(self.stream[learnt], minlength=len(self.words)).astype(np.uint32)
        self.pair_counts = np.bincount(self.pair[learnt], minlength=len(self.pairs)).astype(np.uint32)

    def ranges(self, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(kind, bucket, keys, counts) for every hash range it has keys in."""
        bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, dtype=np.uint64)
        for kind, keys, counts in ((0, self.words, self.word_counts), (1, self.pairs, self.pair_counts)):
            cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
            for b in np.flatnonzero(np.diff(cuts)):
                yield kind, int(b), keys[cuts[b]:cuts[b + 1]], counts[cuts[b]:cuts[b + 1]]


def _send(bits: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                out = [(b, chunk.number, kind, pack_sorted(k), _pack(c)) for kind, b, k, c in chunk.ranges(bits)]
                types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names=["bucket", "chunk", "kind", "keys", "counts"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of one hash range, for each chunk in the order of the keys it sent."""
    out = []
    rows = table.to_pylist()
    for kind in (0, 1):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        keys = [unpack_sorted(r["keys"]) for r in own]
        sizes = np.cumsum([0, *map(len, keys)])
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_unpack(r["counts"], np.uint32) for r in own])
        totals = np.bincount(at, weights=counts, minlength=len(known)).astype(np.uint64)
        for i, r in enumerate(own):
            first = kind == 0 and i == 0
            out.append((r["chunk"], r["bucket"], kind, _pack(totals[at[sizes[i]:sizes[i + 1]]]), int(totals.sum()) if first else 0, int((totals > 0).sum()) if first else 0))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["chunk", "bucket", "kind", "totals", "tokens", "types"])


class Automaton:
    """States are histories by word number; ``arcs`` hold seen bigrams, ``fail`` the failure arcs to the root, ``root`` its arcs."""

    def __init__(self, arcs: dict[int, float], fail: list[float], root: list[float], width: int):
        self.arcs, self.fail, self.root, self.width = arcs, fail, root, width

    def read(self, tokens: list[int], state: int) -> float:
        """Log10 probability of the tokens, from ``state`` on; unknown histories stay at the root."""
        total = 0.0
        arcs, fail, root, width = self.arcs, self.fail, self.root, self.width
        for token in tokens:
            arc = arcs.get(state * width + token)
            total += fail[state] + root[token] if arc is None else arc
            state = token
        return total


class Model:
    """What a chunk's automata are made of: the log-probabilities of its words, failure arcs and seen bigrams."""

    def __init__(self, chunk: Chunk, words: np.ndarray, pairs: np.ndarray, tokens: int, types: int, prior: float):
        self.chunk, self.words, self.pairs = chunk, words, pairs
        self.p = (words + 1.0) / (tokens + types + 1.0)
        self.share = words / (words + prior)
        self.fail, self.root = np.log10(1 - self.share).tolist(), np.log10(self.p).tolist()

    def automaton(self, first: int, last: int) -> Automaton:
        """The part of the model that the tokens from ``first`` to ``last`` can reach."""
        chunk, width = self.chunk, len(self.words)
        own, at = np.unique(chunk.pair[first:last], return_index=True)
        seen = self.pairs[own] > 0
        at = at[seen] + first
        h, w = chunk.before[at].astype(np.int64), chunk.stream[at].astype(np.int64)
        weight = np.log10(self.share[h] * self.pairs[own[seen]] / self.words[h] + (1 - self.share[h]) * self.p[w])
        return Automaton(dict(zip((h * width + w).tolist(), weight.tolist(), strict=True)), self.fail, self.root, width)


def _score(tokens: int, types: int, prior: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        answers = sorted(((r["kind"], r["bucket"], r["totals"]) for r in right.to_pylist()), key=lambda r: r[:2])
        for row in left.to_pylist():
            chunk = Chunk(row)
            words, pairs = (np.concatenate([_unpack(a[2], np.uint64) for a in answers if a[0] == kind]).astype(np.float64) for kind in (0, 1))
            model = Model(chunk, words, pairs, tokens, types, prior)
            known = words > 0
            base = np.log10(model.p)
            reader, reach = None, 0
            for i, doc in enumerate(chunk.docs):
                a, b = int(chunk.first[i]), int(chunk.first[i + 1])
                if b > reach:  # an automaton serves some texts, so that it stays small
                    reach = max(b, int(chunk.first[np.searchsorted(chunk.first, a + READ_TOKENS, side="right") - 1]))
                    reader = model.automaton(a, reach)
                own = chunk.stream[a:b]
                out.append((doc, not row["train"][i], b - a, int(known[own].sum()), math.fsum(base[own]), reader.read(own.tolist(), chunk.end)))
        types_ = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types_, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train: Column, prior: float = 5.0, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs`` (doc_id, text); ``train`` marks what is learnt from."""
    spark = docs.sparkSession
    ship_package(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    chunks = materialize(own.mapInArrow(_chunks(chunk_bytes), CHUNKS), "lm-chunks")
    entries = chunks.agg(F.coalesce(F.sum(F.octet_length("words") / 8 + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0))).first()[0]
    bits = max(3, math.ceil(math.log2(max(1, entries) / RANGE_ENTRIES)))
    sent = chunks.mapInArrow(_send(bits), SENT)
    totals = materialize(sent.groupBy("bucket").applyInArrow(_add_up, TOTALS), "lm-totals")
    free_shuffles(docs)
    tokens, types = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    scored = chunks.groupBy("chunk").cogroup(totals.select("chunk", "bucket", "kind", "totals").groupBy("chunk")).applyInArrow(_score(tokens, types, prior), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
