"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Texts are tokenised once and written with their lengths. A document longer than a sequence gives
whole sequences of its own; what is left of each document is packed by length alone. The histogram
of these lengths (at most one entry for each length below the sequence size, whatever the corpus) is
packed on the driver: lengths are placed longest first, each into the packs with the largest gap it
fits in, and a pattern (a list of slots with the number of packs that look like it) is split where
only some of its packs are taken. Then the emptiest packs are dissolved and their pieces are cut to
fill the gaps of the fuller ones, again longest piece and largest gap first. The single pack that is
left incomplete is cut into sequences whose lengths are powers of two, which need no padding.

A slot of a pattern is a range of ranks among the documents of one length. Ranks come from the place
a document had in its own task and the counts of the tasks before it, so a length that a third of
all documents share is ranked by all tasks. The patterns are joined back to the documents by rank.

Words are encoded once a task and looked up by their 64-bit hash (equal hashes are taken as equal
words); a word ends at a blank and between an ASCII letter or digit and a sign. The tokenizer must
ignore case and white space and let no token cross these places, as ``word_bpe_49k`` does;
``test_packing`` holds the ids against whole-text encoding.

Defined results: a null text counts as empty, and an empty text is the end id alone; repeated rows
and rows without an id are packed each for itself; an empty table gives no rows; other columns are
not read. Whole sequences of long documents are numbered after the packed ones.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, ship_package

from .text import BLANK_WORDS, Words, pieces, ragged_index

TOKEN_SCHEMA = "part int, doc_id long, ids binary, tokens long, rest int, place long, whole long, whole_place long"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CACHED_WORDS = 1 << 19
LINE = 200
PIECE_BYTES = 2 << 20
_RANKS = 44


def _cuts(b: np.ndarray) -> np.ndarray:
    """Bytes before which a token always starts: an ASCII sign other than the apostrophe after a letter or digit, and the other way round."""
    low = b | 0x20
    plain = (low >= 97) & (low <= 122) | (b >= 48) & (b <= 57)
    sign = (b > 32) & (b < 127) & ~plain & (b != 39)
    out = np.zeros(len(b), dtype=bool)
    out[1:] = plain[1:] & sign[:-1] | sign[1:] & plain[:-1]
    return out


class Encoder:
    """Token ids of words, each distinct word encoded once (the memory of words starts anew when it is full)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.first, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def words(self, raw: np.ndarray, offs: np.ndarray) -> Words:
        """What is looked up: pieces of words in lower case; whole words as written where the text spells a special token."""
        data = raw.tobytes()
        if any(t in data for t in self.special):
            return Words(raw, offs, BLANK_WORDS, False)
        return Words(raw, offs, BLANK_WORDS, True, _cuts)

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order)."""
        if len(self.hashes) > CACHED_WORDS:
            self._clear()
        hashes, where, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            sizes, ids = self._encode([words.text(i) for i in where[new].tolist()])
            numbers = len(self.first) - 1 + np.arange(len(new))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
            self.hashes, self.numbers = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.numbers, at[new], numbers)
        number = self.numbers[np.searchsorted(self.hashes, hashes)][back]
        n = self.first[number + 1] - self.first[number]
        return n, self.ids[ragged_index(self.first[number], n)]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids); words are encoded some at a time, with blanks between them."""
        sizes, ids = [], []
        lines = [words[i:i + LINE] for i in range(0, len(words), LINE)]
        for line, found in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            starts = np.cumsum([0] + [len(w) + 1 for w in line])
            tokens = np.array([a for a, _ in found.offsets], dtype=np.int64)
            sizes.append(np.bincount(np.searchsorted(starts, tokens, side="right") - 1, minlength=len(line)))
            ids.append(np.array(found.ids, dtype=np.uint32))
        return np.concatenate(sizes), np.concatenate(ids)


def id_kind(tokenizer: str, end_id: int) -> str:
    """How the written ids are stored: two bytes each where all ids fit."""
    from tokenizers import Tokenizer
    return "<u4" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) > 1 << 16 else "<u2"


def tokenised(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """One written row a document: its ids, and its place among the rows of its task that leave as many tokens over."""
    kind = id_kind(tokenizer, end_id)

    def encode(batches):
        encoder, part = Encoder(tokenizer), TaskContext.get().partitionId()
        places, wholes = np.zeros(size, dtype=np.int64), 0
        for batch, raw, offs in pieces(batches, "text", PIECE_BYTES):
            words = encoder.words(raw, offs)
            n, ids = encoder.encode(words)
            upto = np.concatenate([[0], np.cumsum(n)])[words.first]
            rows = batch.num_rows
            ends = upto + np.arange(rows + 1)
            flat = np.full(len(ids) + rows, end_id, dtype=kind)
            flat[ragged_index(ends[:-1], np.diff(upto))] = ids
            tokens = np.diff(ends)
            rest, whole = tokens % size, tokens // size
            order = np.argsort(rest, kind="stable")
            group, at, count = np.unique(rest[order], return_index=True, return_counts=True)
            place = np.empty(rows, dtype=np.int64)
            place[order] = np.arange(rows) - np.repeat(at, count) + places[rest[order]]
            places[group] += count
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows, part), type=pa.int32()), batch.column(0),
                pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)]),
                pa.array(tokens, type=pa.int64()), pa.array(rest, type=pa.int32()), pa.array(place),
                pa.array(whole, type=pa.int64()), pa.array(wholes + np.cumsum(whole) - whole, type=pa.int64()),
            ], names=["part", "doc_id", "ids", "tokens", "rest", "place", "whole", "whole_place"])
            wholes += int(whole.sum())

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(docs.mapInArrow(encode, TOKEN_SCHEMA), "packing-tokens")


@dataclass
class Slot:
    """In the k-th pack of a pattern: the documents of ``length`` with the ranks lo + k * times up to lo + (k + 1) * times, tokens start to start + size of each."""

    length: int
    lo: int
    times: int
    start: int
    size: int


@dataclass
class Pattern:
    count: int
    gap: int
    slots: list[Slot] = field(default_factory=list)

    def split(self, count: int) -> Pattern:
        """The first ``count`` packs as a pattern of their own; this one keeps the others."""
        head = Pattern(count, self.gap, [Slot(s.length, s.lo, s.times, s.start, s.size) for s in self.slots])
        for s in self.slots:
            s.lo += count * s.times
        self.count -= count
        return head

    def add(self, slot: Slot) -> None:
        self.slots.append(slot)
        self.gap -= slot.times * slot.size


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns of packs of at most ``size`` for the counts of each length, as placing the documents one by one would give.

    Every document goes to the pack with the largest gap, longest documents first; a new pack is
    opened when none has room. All documents of one length are placed together: the packs' gaps at
    the moments they are taken are the largest ones of the sequence gap, gap - length, ...
    """
    found: list[Pattern] = []
    for length in sorted(histogram, reverse=True):
        n, at = histogram[length], 0
        room = sorted((p for p in found if p.gap >= length), key=lambda p: -p.gap)
        gaps, counts = np.array([p.gap for p in room], dtype=np.int64), np.array([p.count for p in room], dtype=np.int64)
        most = gaps // length

        def taken(level: int, gaps=gaps, most=most, length=length) -> np.ndarray:
            """Documents a pack takes while its gap is above the level."""
            return np.minimum(most, np.maximum(0, -((level - gaps) // length)))

        low, high = length - 1, size
        while low < high:  # the lowest level that the documents suffice for
            mid = (low + high) // 2
            if int((taken(mid) * counts).sum()) <= n:
                high = mid
            else:
                low = mid + 1
        times = taken(low)
        more = n - int((times * counts).sum())  # one more each for some of the packs whose gap is now at the level
        for p, t, again in zip(room, times.tolist(), ((gaps - times * length == low) & (times < most)).tolist(), strict=True):
            if again and more:
                k = min(more, p.count)
                more -= k
                head = p
                if k < p.count:
                    head = p.split(k)
                    found.append(head)
                head.add(Slot(length, at, t + 1, 0, length))
                at += k * (t + 1)
                if head is p:
                    continue
            if t:
                p.add(Slot(length, at, t, 0, length))
                at += p.count * t
        left, fit = n - at, size // length
        for count, t in ((left // fit, fit), (1, left % fit)):
            if count and t:
                found.append(Pattern(count, size - t * length, [Slot(length, at, t, 0, length)]))
                at += count * t
    return found


def fill_gaps(packs: list[Pattern], size: int) -> list[Pattern]:
    """The packs with the emptiest ones cut into the gaps of the others, and one last pack for the tokens that complete none."""
    done, open_ = [p for p in packs if not p.gap], sorted((p for p in packs if p.gap), key=lambda p: p.gap)
    keep = sum(p.count * (size - p.gap) for p in open_) // size
    kept, loose = [], []
    for p in open_:
        if keep >= p.count:
            kept.append(p)
            keep -= p.count
            continue
        if keep:
            kept.append(p.split(keep))
            keep = 0
        # (-size, documents, length, first rank, start): pieces that look for a place
        loose += [(-s.size, p.count * s.times, s.length, s.lo, s.start) for s in p.slots]
    loose.sort()
    heapify(loose)
    heap = [(-p.gap, i) for i, p in enumerate(kept)]
    heapify(heap)
    last = Pattern(1, size)
    while loose:
        piece, n, length, lo, start = heappop(loose)
        piece = -piece
        if not heap:  # fewer than size tokens are left
            for k in range(n):
                last.add(Slot(length, lo + k, 1, start, piece))
            continue
        gap, i = heappop(heap)
        p = kept[i]
        k = min(n, p.count)
        if k < p.count:
            kept.append(p.split(k))
            heappush(heap, (gap, i))
            i = len(kept) - 1
            p = kept[i]
        part = min(piece, -gap)
        p.add(Slot(length, lo, 1, start, part))
        if p.gap:
            heappush(heap, (-p.gap, i))
        if k < n:
            heappush(loose, (-piece, n - k, length, lo + k, start))
        if part < piece:
            heappush(loose, (part - piece, k, length, lo, start + part))
    return done + kept + ([last] if last.slots else [])


def whole_powers(packs: list[Pattern], size: int) -> list[Pattern]:
    """The incomplete pack, whose slots hold one document each, cut into packs whose lengths are powers of two."""
    out = []
    for p in packs:
        if not p.gap:
            out.append(p)
            continue
        total, slots = size - p.gap, list(p.slots)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            pack = Pattern(p.count, 0, [])
            while room:
                s = slots.pop(0)
                if s.size <= room:
                    pack.slots.append(s)
                    room -= s.size
                else:
                    pack.slots.append(Slot(s.length, s.lo, 1, s.start, room))
                    slots.insert(0, Slot(s.length, s.lo, 1, s.start + room, s.size - room))
                    room = 0
            out.append(pack)
    return out


def pack_histogram(histogram: dict[int, int], size: int) -> list[Pattern]:
    return whole_powers(fill_gaps(shortest_pack_first(histogram, size), size), size)


class Places:
    """The slots of all patterns by length and rank, for a vectorised join with documents."""

    def __init__(self, packs: list[Pattern]):
        by_length: dict[int, list] = {}
        base = 0
        for p in packs:
            off = 0
            for s in p.slots:
                by_length.setdefault(s.length, []).append((s.lo, s.lo + p.count * s.times, s.times, s.start, s.size, base, off))
                off += s.times * s.size
            base += p.count
        self.sequences = base
        keys, counts, slots = [], [], []
        for length in sorted(by_length):
            mine = sorted(by_length[length])
            cuts = sorted({x for s in mine for x in s[:2]})
            inside: list[list] = [[] for _ in cuts]
            for s in mine:
                for k in range(bisect_left(cuts, s[0]), bisect_left(cuts, s[1])):
                    inside[k].append(s)
            for c, held in zip(cuts, inside, strict=True):
                keys.append(length << _RANKS | c)
                counts.append(len(held))
                slots += held
        self.keys, self.counts = np.array(keys, dtype=np.int64), np.array(counts, dtype=np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.slots = np.array(slots, dtype=np.int64).reshape(-1, 7)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(position of the document, start, size, sequence, offset) of every piece."""
        if not len(length) or not len(self.keys):
            return (np.zeros(0, dtype=np.int64),) * 5
        at = np.searchsorted(self.keys, length.astype(np.int64) << _RANKS | rank, side="right") - 1
        n = self.counts[at]
        lo, _, times, start, size, base, off = self.slots[ragged_index(self.first[at], n)].T
        doc = np.repeat(np.arange(len(length)), n)
        k = rank[doc] - lo
        return doc, start, size, base + k // times, off + k % times * size


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, start and length in the document's ids, their crc32, doc_tokens, sequence_id and offset in the sequence.

    ``docs`` has doc_id and text; ``tokenizer`` is the path of a tokenizer file that driver and
    executors have. A sequence is complete (``size`` tokens) or a power of two long.
    """
    spark = docs.sparkSession
    ship_package(spark)
    tokens = tokenised(docs, tokenizer, size, end_id)
    kind = id_kind(tokenizer, end_id)

    counts = tokens.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole"))
    counts = materialize(counts, "packing-counts")
    histogram = {r["rest"]: r["n"] for r in counts.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most size - 1 rows
    places = Places(pack_histogram(histogram, size))

    # ranks: the rows of earlier tasks with the same length, and the whole sequences of earlier tasks
    both = counts.select("part", "rest", "n").unionByName(counts.groupBy("part").agg(F.sum("whole").alias("n")).withColumn("rest", F.lit(size)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = materialize(both.select("part", "rest", before.alias("before")), "packing-ranks")
    own = both.filter(F.col("rest") < size).join(both.filter(F.col("rest") == size).select("part", F.col("before").alias("wholes")), "part")
    ranked = tokens.join(own, ["part", "rest"]).select(
        "doc_id", "ids", "tokens", "rest", (F.col("place") + F.col("before")).alias("rank"), "whole", (F.col("whole_place") + F.col("wholes")).alias("whole_rank"))
    shared = spark.sparkContext.broadcast(places)  # at most a few slots for each length below the sequence size

    def cut(batches):
        found = shared.value
        for batch in batches:
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            rest, whole, n = col("rest"), col("whole"), col("tokens")
            left = np.flatnonzero(rest > 0)
            doc, start, length, sequence, offset = found.find(rest[left], col("rank")[left])
            doc = left[doc] if len(doc) else doc
            start = start + whole[doc] * size
            long = np.repeat(np.arange(len(whole)), whole)
            k = ragged_index(np.zeros(len(whole), dtype=np.int64), whole)
            doc, start = np.concatenate([doc, long]), np.concatenate([start, k * size])
            length = np.concatenate([length, np.full(len(long), size)])
            sequence = np.concatenate([sequence, found.sequences + col("whole_rank")[long] + k])
            offset = np.concatenate([offset, np.zeros(len(long), dtype=np.int64)])
            order = np.argsort(doc, kind="stable")
            doc, start, length, sequence, offset = (x[order] for x in (doc, start, length, sequence, offset))
            crc, at, ids = np.empty(len(doc), dtype=np.int64), -1, b""
            binary = batch.column(batch.schema.get_field_index("ids"))
            for j, (d, a, m) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                if d != at:
                    at, ids = d, np.frombuffer(binary[d].as_buffer(), dtype=kind).astype("<u4")
                crc[j] = zlib.crc32(ids[a:a + m])
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(doc)), pa.array(start), pa.array(length, type=pa.int64()),
                pa.array(crc), pa.array(n[doc], type=pa.int64()), pa.array(sequence), pa.array(offset),
            ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(cut, PIECE_SCHEMA)
