"""Spelling variants: words one edit apart, found by composing the vocabulary acceptor with a one-edit transducer and itself.

Words are counted over all texts, with one letter dropped at fixed pseudo-random places. The frequent
ones are the vocabulary. It is split by the state that the first letters lead to from the initial
state; each part becomes a minimised acceptor, and the states of the composition are pairs of its
states with the number of edits made. While no edit is made both states are the same, so the edits
possible at a state are found once for the state and hold for all prefixes that lead to it; after
the edit both must read the same letters. An inserted letter must differ from the next common one,
so every pair has one accepting path.

Edits within the first letters are found by the same composition of the reversed acceptor, split by
the last letters, which such pairs share. A part of more than ``most`` words is split by more letters
(2, 4, 8, ...); pairs whose edit lies within these share all but that letter and are grouped by the
word without it, which is exact, and such a group is no larger than the alphabet.

Parts give one row a word, with its number of near words and the best of them, so what is merged is
bounded by the vocabulary and not by the pairs. Roots follow by pointer jumping over written tables.

Defined results: a null text has no words; a null id counts as an empty one; repeated rows count
again (with equal ids they drop the same letters); an empty table gives no rows; other columns are
not read. Words are grouped by 64-bit hashes within a slice of a task (equal hashes are taken as equal words).
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, ship_package

from .text import Words, pieces

COUNT_SCHEMA = "word string, n long"
NEAR_SCHEMA = "word string, n_near long, form string, form_n long"
_FLUSH = 200_000
_SHORT = 64
FIRST, LAST = 2, 3


def _letters(b: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and of U+00C0 to U+00FF (the byte 0xC3 and the one after it)."""
    low = b | 0x20
    lead = b == 0xC3
    out = ((low >= 97) & (low <= 122)) | lead
    out[1:] |= lead[:-1]
    return out


def _zero_tables(longest: int) -> np.ndarray:
    """[n, lane, byte]: what n zero bytes make of a CRC-32 register that holds the byte in that lane."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(longest):
        out[n + 1] = step[out[n] & 255] ^ (out[n] >> 8)
    return out


def _joined_crc(tables: np.ndarray, before: np.ndarray, size: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings written after each other, from theirs and the second one's size."""
    return tables[size, 0, before & 255] ^ tables[size, 1, before >> 8 & 255] ^ tables[size, 2, before >> 16 & 255] ^ tables[size, 3, before >> 24] ^ crc


def word_counts(docs: DataFrame, shortest: int = 5, every: int = 97) -> DataFrame:
    """(word, n) over all texts, after dropping a letter of every run whose checksum with its document's id ``every`` divides."""

    def count(batches):
        tables = _zero_tables(_SHORT)
        held: dict[str, int] = defaultdict(int)

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.string()), pa.array(list(held.values()), type=pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch, raw, offs in pieces(batches, "text"):
            words = Words(raw, offs, _letters, True)
            if not len(words.start):
                continue
            _, where, back, total = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
            size = words.end - words.start
            texts = [words.buf[words.start[i]:words.end[i]].tobytes() for i in where.tolist()]
            crc = np.array([zlib.crc32(t) for t in texts], dtype=np.uint32)
            before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column(0).to_pylist()], dtype=np.uint32)[words.row]
            h = _joined_crc(tables, before, np.minimum(size, _SHORT), crc[back])
            for i in np.flatnonzero(size > _SHORT).tolist():
                h[i] = zlib.crc32(texts[back[i]], int(before[i]))
            cut = np.flatnonzero(h % every == 0)
            total -= np.bincount(back[cut], minlength=len(texts))
            decoded = [t.decode("utf-8") for t in texts]
            for t, n in zip(decoded, total.tolist(), strict=True):
                if n and len(t) >= shortest:
                    held[t] += n
            for i in cut.tolist():
                t = decoded[back[i]]
                if len(t) > shortest:
                    at = int(h[i]) % len(t)
                    held[t[:at] + t[at + 1:]] += 1
            if len(held) > _FLUSH:
                yield rows()
        yield rows()

    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(count, COUNT_SCHEMA).groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acyclic acceptor of some sorted words; states are numbered from the ends to the initial state.

    ``offset`` of an arc is the number of words of its state that stand before those that take it, so
    a path's offsets add up to the word's number.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []  # letter: (target, offset)
        self.count: list[int] = []
        register: dict[tuple, int] = {}

        def settle(final: bool, arcs: list[tuple[str, int]]) -> int:
            key = (final, *arcs)
            state = register.get(key)
            if state is None:
                state = register[key] = len(self.final)
                at, out = int(final), {}
                for letter, target in arcs:
                    out[letter] = (target, at)
                    at += self.count[target]
                self.final.append(final)
                self.arcs.append(out)
                self.count.append(at)
            return state

        path: list[tuple[list[bool], list]] = [([False], [])]
        last = ""
        for word in [*words, ""]:
            common = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                common += 1
            while len(path) - 1 > common:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(final[0], arcs)))
            path += [([False], []) for _ in word[common:]]
            if word or (words and words[0] == ""):
                path[-1][0][0] = True
            last = word
        self.initial = settle(path[0][0][0], path[0][1])

    def common(self, p: int, q: int, most: int | None) -> list[tuple[int, int]]:
        """Numbers of the words that both states accept, of ``most`` letters at most."""
        out, open_ = [], [(p, q, 0, 0, most)]
        while open_:
            p, q, i, j, left = open_.pop()
            if p == q and left is None:
                out += [(i + k, j + k) for k in range(self.count[p])]
                continue
            if self.final[p] and self.final[q]:
                out.append((i, j))
            if left == 0:
                continue
            a, b = self.arcs[p], self.arcs[q]
            for letter in (a if len(a) <= len(b) else b):
                if letter in a and letter in b:
                    (s, x), (t, y) = a[letter], b[letter]
                    open_.append((s, t, i + x, j + y, None if left is None else left - 1))
        return out

    def edits(self, state: int, most: int | None) -> list[tuple[int, int]]:
        """Pairs of the state's words whose first difference is at the state itself, with ``most`` common letters after the edit at most."""
        out, arcs = [], list(self.arcs[state].items())
        for k, (letter, (s, x)) in enumerate(arcs):
            for _, (t, y) in arcs[k + 1:]:  # another letter
                out += [(x + i, y + j) for i, j in self.common(s, t, most)]
            if self.final[s] and self.final[state]:  # one letter more
                out.append((x, 0))
            if most == 0:
                continue
            after = self.arcs[s]
            for other, (t, y) in arcs:
                if other != letter and other in after:
                    u, z = after[other]
                    out += [(x + z + i, y + j) for i, j in self.common(u, t, None if most is None else most - 1)]
        return out

    def pairs(self, most: int | None = None) -> Iterator[tuple[int, int]]:
        """Numbers of the words that are exactly one edit apart."""
        starts: list[list[int]] = [[] for _ in self.final]
        starts[self.initial] = [0]
        for state in range(self.initial, -1, -1):  # every state stands after those that lead to it
            found = self.edits(state, most)
            for target, offset in self.arcs[state].values():
                starts[target] += [s + offset for s in starts[state]]
            for s in starts[state] if found else ():
                for i, j in found:
                    yield s + i, s + j
            starts[state] = []


class _Near:
    """Number of near words and the best one, for some words."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.near = [0] * len(words)
        self.best: list[tuple | None] = [None] * len(words)

    def pair(self, i: int, j: int) -> None:
        for a, b in ((i, j), (j, i)):
            self.near[a] += 1
            key = (-self.n[b], self.words[b])
            if self.best[a] is None or key < self.best[a]:
                self.best[a] = key

    def rows(self) -> Iterator[tuple]:
        for word, near, best in zip(self.words, self.near, self.best, strict=True):
            if near:
                yield word, near, best[1], -best[0]


def _parts(batches) -> Iterator[tuple[str, list[str], list[int]]]:
    """(key, words, counts) of the rows, which are sorted by key."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    for key, part in groupby(rows, key=lambda r: r[0]):
        _, words, n = zip(*part, strict=True)
        yield key, list(words), list(n)


def _batches(rows: Iterator[tuple], size: int = 10_000):
    held: list[tuple] = []
    names = ["word", "n_near", "form", "form_n"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _forward(batches):
    """Pairs that share the letters of their part."""

    def found():
        for key, words, n in _parts(batches):
            if len(words) > 1:
                near, skip = _Near(words, n), len(key)
                for i, j in Acceptor([w[skip:] for w in words]).pairs():
                    near.pair(i, j)
                yield from near.rows()

    return _batches(found())


def _backward(batches):
    """Pairs that differ within the first letters, among words sorted by their reversal."""

    def found():
        for _, words, n in _parts(batches):
            if len(words) > 1:
                near = _Near(words, n)
                for i, j in Acceptor([w[::-1][LAST:] for w in words]).pairs(FIRST - 1):
                    if words[i][:FIRST] != words[j][:FIRST]:
                        near.pair(i, j)
                yield from near.rows()

    return _batches(found())


def _without(batches):
    """Pairs that differ in the letter their key leaves out (or has no letter there, for the word that is the key itself)."""

    def found():
        for key, words, n in _parts(batches):
            if len(words) > 1:
                at, rest = key.split(":", 1)
                near, at = _Near(words, n), int(at)
                for i, a in enumerate(words):
                    for j in range(i):
                        b = words[j]
                        if (a != rest and b != rest) or (b if a == rest else a)[at] != rest[at:at + 1]:
                            near.pair(i, j)
                yield from near.rows()

    return _batches(found())


def _run(rows: DataFrame, by, how) -> DataFrame:
    return rows.select("key", "word", "n").repartition("key").sortWithinPartitions("key", by).mapInArrow(how, NEAR_SCHEMA)


def _left_out(words: DataFrame, low: int, high) -> DataFrame:
    """Each word under itself without its letter at each place from ``low`` up to ``high`` (exclusive), and under itself for each such place."""
    places = F.sequence(F.lit(low), F.least(F.lit(high) if isinstance(high, int) else high, F.length("word") + 1) - 1)
    each = words.select("word", "n", F.explode(places).alias("at"))
    key = F.when(F.col("at") < F.length("word"), F.concat(F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2)))
    both = F.explode(F.filter(F.array(key, F.col("word")), lambda k: k.isNotNull()))
    return each.select("word", "n", "at", both.alias("rest")).select(F.concat_ws(":", F.col("at").cast("string"), "rest").alias("key"), "word", "n")


def near_words(words: DataFrame, most: int = 20_000) -> DataFrame:
    """(word, n_near, form, form_n) of every word with a near one: how many, and the one of largest n. ``words`` is a written (word, n)."""
    parts, level, left = [], FIRST, words
    while True:
        keyed = left.select("word", "n", F.substring("word", 1, level).alias("key"))
        large = materialize(keyed.groupBy("key").count().filter(F.col("count") > most).select("key"), "spelling-large")
        if large.isEmpty():
            parts.append(_run(keyed, "word", _forward))
            break
        parts.append(_run(keyed.join(large, "key", "left_anti"), "word", _forward))
        left = materialize(keyed.join(large, "key", "left_semi").select("word", "n"), "spelling-left")
        parts.append(_run(_left_out(left, level, 2 * level), "word", _without))
        level *= 2
    keyed = words.select("word", "n", F.reverse(F.substr("word", F.length("word") - (LAST - 1))).alias("key"))
    large = materialize(keyed.groupBy("key").count().filter(F.col("count") > most).select("key"), "spelling-large")
    parts.append(_run(keyed.join(large, "key", "left_anti"), F.reverse("word"), _backward))
    if not large.isEmpty():
        parts.append(_run(_left_out(keyed.join(large, "key", "left_semi").select("word", "n"), 0, FIRST), "word", _without))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("form_n")).alias("least"), "form"))
    every = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return every.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.least")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last one reached; each round doubles the steps taken. ``links`` is a written (word, form) without cycles."""
    now = links.select("word", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = materialize(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, ratio: int = 2, most: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``shortest`` letters and ``least`` occurrences or more.

    ``docs`` has doc_id and text. A word's form is its near word of largest n (ties: the smallest in
    code-point order) where that n is ``ratio`` times its own at least.
    """
    ship_package(docs.sparkSession)
    words = materialize(word_counts(docs, shortest, every).filter(F.col("n") >= least), "spelling-words")
    near = words.join(near_words(words, most), "word", "left")
    right = F.col("form_n") >= ratio * F.col("n")
    near = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(right, F.col("form")).alias("form"), F.when(right, F.col("form_n")).alias("form_n")), "spelling-near")
    last = roots(near.filter("form is not null"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
