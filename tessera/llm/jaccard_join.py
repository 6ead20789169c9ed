"""Exact Jaccard self-join of word n-gram sets by universe partition and the pigeonhole principle.

Sizes are cut into bands. For two sets whose larger one lies in a band, Jaccard similarity of at
least ``num / den`` bounds the size of their symmetric difference by H. The universe of n-grams is
hashed into segments; a segment is allotted weight 1 (its part of the set must be equal) or weight 2
(equal but for one n-gram: the one-deletion neighbourhood of the part is indexed as well), and the
weights add up to H + 1 + slack. Two linked sets then agree in segments of weight 1 + slack at
least, so each set leaves out its ``slack`` most frequent weight-1 signatures (by one order shared
by all) and the least frequent agreeing signature of every linked pair is still indexed by both.
A cost model on the sets of each band chooses segments, weights and slack; frequencies
are estimated on a bounded sample of sets, which changes the cost but never the result.

Equal sets are one class and only its smallest id is indexed. Every signature's sets are first
paired with the smallest one; after those pairs are verified and joined to components, only pairs
of one signature that lie in different components are left to verify. Sets that descend from one text
or hold one long passage, but are not similar, meet in many signatures all the same. So where a signature would still
make more pairs than it costs to index its sets once more, its sets are first paired with a few others of the signature
drawn by hash, and once more if that joins components, where all these pairs are more than the sets (near copies of one text become one component by a few pairs each). Those of
signatures that are still too large are indexed once more, by
themselves, in the finest partition: every n-gram is a segment, and of those a set can afford to lose, plus
one, the rarest are its signatures. A linked pair that no other signature shows has both its sets in this second index, so
nothing is lost. Sizes and parity bits rule out most chance meetings (bits of parity differ
in no more places than the sets do): a signature's sets carry folded bits, which the join of the signature
compares before a pair becomes a row. A set is compared with as many others a signature as it has
n-grams in a second index, about, and not with its whole group; the bits are compared there as well. The rest is verified on whole sets, made anew from the texts.

Defined results: null or empty texts, and texts without words, have an empty set and no links;
texts of fewer than ``n`` words are one n-gram; rows repeated under one id each get the component of
their own text; a null id is never a component's name but its row gets the component of its text
(null when it has none); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, ship_package

from .graph import components, free_shuffles
from .text import BLANK_WORDS, Words, mix, pieces, ragged, runs, seeded

RATIO = 1.5
#: 64-bit words of parity bits kept for a set, at least.
PARITY = 16
ID_BITS = 1 << 23
#: Pairs a signature may make for each n-gram of a second index of its sets; sets sampled to order n-grams (steers the cost only).
PAIRS_A_GRAM, GRAM_SETS = 1.0, 2_000
#: Sets of a crowded signature that all its others are paired with at a time, and how often at most (both only steer the cost).
CENTRES, ROUNDS = 4, 2
#: Sets sampled for signature frequencies, and frequent signatures kept (both only steer the cost).
SAMPLE_SETS, FREQUENT = 20_000, 50_000


def edges_of_bands(largest: int = 1 << 31) -> np.ndarray:
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * RATIO)))
    return np.array(out, dtype=np.int64)


BANDS = edges_of_bands()


def most_apart(total: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes add up to at most ``total``."""
    return max(t - 2 * (-(-num * t // (num + den))) for t in range(max(2, total - 60), total + 1))


def allocate(low: int, high: int, sets: int, num: int, den: int) -> tuple[int, int, int]:
    """(weight-1 segments, weight-2 segments, slack) of a band of sizes [low, high) with so many sets.

    Cost: indexed signatures a set, plus the chance meetings each set must expect. A meeting is
    unearned where a part is empty in both sets (or within one n-gram of empty, for weight 2).
    """
    apart = most_apart(2 * (high - 1), num, den)
    if apart <= 0:
        return 0, 0, 0
    best = None
    for two in range(min(6, apart + 1) + 1):
        one = max(0, apart + 1 - 2 * two)
        slack = 0
        while True:
            part = max(1, math.floor(low * num / den)) / max(1, one + slack + two)
            empty = (one + slack) * math.exp(-part)
            if slack >= empty + 4 * math.sqrt(empty) or slack > one or one == 0:
                break
            slack += max(1, slack // 4)
        g = low / max(1, one + slack + two)
        met = (0 if slack else one) * math.exp(-2 * g) + two * math.exp(-2 * g) * (1 + 2 * g)
        cost = one + two * (1 + g) + 20 * min(sets, 10**7) * met
        if best is None or cost < best[0]:
            best = (cost, one + slack, two, slack)
    return best[1:]


def sets_of(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes sorted and distinct by row, row offsets)."""
    words = Words(raw, offs, BLANK_WORDS, True)
    at, h = runs(words.hash, words.first, n)
    bounds = np.searchsorted(at, words.first)
    counts = words.counts()
    out, sizes = [], np.zeros(words.rows, dtype=np.int64)
    for i in range(words.rows):
        if 0 < counts[i] < n:
            s = words.hash[words.first[i]:words.first[i + 1]]
            row = mix(np.array([sum(int(x) * pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k, x in enumerate(s)) & ((1 << 64) - 1)], dtype=np.uint64) + np.uint64(counts[i]))
        else:
            row = np.unique(h[bounds[i]:bounds[i + 1]])
        sizes[i] = len(row)
        out.append(row)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _sum_by_row(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def parities(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each row's set, as 64-bit words and row offsets: bit i is the parity of the members that hash to i.

    The bits in which two sets differ are no more than the members of their symmetric difference. A
    set gets twice as many bits as members or more (a power of two); halves of a longer
    row fold onto each other by exclusive or, which gives the bits of half the length.
    """
    size = np.diff(first)
    words = np.maximum(PARITY, 1 << np.ceil(np.log2(np.maximum(size, 1) / 32)).astype(np.int64).clip(0))
    begin = np.concatenate([[0], np.cumsum(words)])
    row = np.repeat(np.arange(len(size)), size)
    at = (seeded(h, 4) & (words[row].astype(np.uint64) * np.uint64(64) - np.uint64(1))).astype(np.int64)
    odd = np.bincount(begin[row] * 64 + at, minlength=begin[-1] * 64).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, 64), axis=1).view(np.int64).ravel(), begin


def describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, set size, a 128-bit hash of the set and its parity bits, for every row."""

    def run(batches):
        for batch, raw, offs in pieces(batches, "text"):
            h, first = sets_of(raw, offs, n)
            bits, begin = parities(h, first)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(first), type=pa.int64()),
                pa.array(_sum_by_row(seeded(h, 1), first).view(np.int64)), pa.array(_sum_by_row(seeded(h, 2), first).view(np.int64)),
                ragged(bits, begin, pa.int64()),
            ], names=["doc_id", "n_shingles", "h1", "h2", "bits"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bits array<long>")


def alike(x, y, num: int, den: int) -> Column:
    """Whether the sizes and parity bits of x and y leave the similarity possible; true for every linked pair.

    x and y are prefixes (columns x_n, x_bits, …) or structs with n and bits.
    """
    (x_n, x_bits), (y_n, y_bits) = ((F.col(f"{k}_n"), F.col(f"{k}_bits")) if isinstance(k, str) else (k["n"], k["bits"]) for k in (x, y))
    total = x_n + y_n
    apart = total - 2 * F.ceil(F.lit(num) * total / F.lit(num + den) - 1e-9)
    xor = lambda u, v: F.zip_with(u, v, lambda i, j: i.bitwiseXOR(j))
    # linked sets differ in size by the similarity at most, so their rows of bits by one doubling
    fold = lambda c, to: F.when(F.size(c) == 2 * to, xor(F.slice(c, F.lit(1), to), F.slice(c, to + 1, to))).otherwise(c)
    least = F.least(F.size(x_bits), F.size(y_bits))
    differ = F.aggregate(F.zip_with(fold(x_bits, least), fold(y_bits, least), lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda n, i: n + i)
    return (x_n * den >= y_n * num) & (y_n * den >= x_n * num) & (differ <= apart)


def possible(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parity bits do not rule out the similarity; no linked pair is lost."""
    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(alike("a", "b", num, den)).select("a", "b")


def fineness(num: int, den: int) -> int:
    """How many bits a member ``faces`` carry at most (they carry half as many at least, or 64).

    Of two unrelated sets about half of the bits differ; those that linked sets may differ in stay well
    below that, a third of the bits at most.
    """
    apart, fine = 2 * (den - num) / (num + den), 1
    while 6 * apart > fine and fine < 2:  # ``describe`` has two bits a member or more
        fine *= 2
    return fine


def faces(reps: DataFrame, fine: int = 1) -> DataFrame:
    """doc_id, n and the parity bits folded to between half of ``fine`` and ``fine`` bits a member, to be carried by every signature of a set."""
    words = F.pow(F.lit(2), F.floor(F.log2(F.greatest(fine * F.col("n_shingles"), F.lit(64)) / 64))).cast("int")
    folded = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: F.aggregate(
        F.sequence(F.lit(0), (F.size("bits") / F.col("words")).cast("int") - 1), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get("bits", i + j * F.col("words")))))
    return reps.withColumn("words", words).select("doc_id", F.col("n_shingles").alias("n"), folded.alias("bits"))


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bit for each hash value of ``ID_BITS`` that one of the doc_ids has: 1 MB, however many they are."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    rows = ids.select(at.alias("at")).groupBy((F.col("at") / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
    out = np.zeros((ID_BITS // 32768, 4096), dtype=np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return np.unpackbits(out.ravel(), bitorder="little").astype(bool)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and the whole compressed text of the given ids (a set of 64-bit hashes takes three times its packed text).

    The bits of the ids keep most other texts out of the shuffle of the exact join that follows.
    """
    wanted = np.packbits(id_bits(ids))

    def run(batches):
        code, bits = zstandard.ZstdCompressor(level=1), np.unpackbits(wanted).astype(bool)
        for batch, raw, offs in pieces(batches, "text"):
            rows = np.flatnonzero(bits[batch.column(2).to_numpy()])
            packed = [code.compress(raw[offs[i]:offs[i + 1]].tobytes()) for i in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(packed, type=pa.binary())], names=["doc_id", "packed"])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    return docs.select("doc_id", "text", at.alias("at")).mapInArrow(run, "doc_id long, packed binary").join(ids, "doc_id", "left_semi")


def _memberships(size: np.ndarray, num: int, den: int):
    """For each scheme offset: (rows, band) of the sets that take part."""
    band = np.searchsorted(BANDS, size, side="right") - 1
    for k in range(3):
        b = np.minimum(band + k, len(BANDS) - 2)
        rows = np.flatnonzero((size > 0) & ((size * den >= num * BANDS[b]) if k else True))
        if len(rows):
            yield rows, b[rows]


def signatures(h: np.ndarray, first: np.ndarray, plan: dict[int, tuple[int, int, int]], frequent: tuple[np.ndarray, np.ndarray],
               num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) pairs of some sets under the bands' allocations."""
    rows_out, sig_out = [], []
    size = np.diff(first)
    value = seeded(h, 3)
    shape = np.zeros((len(BANDS), 3), dtype=np.int64)
    for b, p in plan.items():
        shape[b] = p
    listed, often = frequent
    for rows, band in _memberships(size, num, den):
        one, two, slack = shape[band].T
        segments = one + two
        keep = segments > 0
        rows, band, two, slack, segments = rows[keep], band[keep], two[keep], slack[keep], segments[keep]
        if not len(rows):
            continue
        base = np.concatenate([[0], np.cumsum(segments)])
        reps = size[rows]
        at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        own = np.repeat(np.arange(len(rows)), reps)
        seg = (mix(h[at] ^ (band[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % segments[own].astype(np.uint64)).astype(np.int64)
        key = base[own] + seg
        sums = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(sums, key, value[at])
        row_of = np.repeat(np.arange(len(rows)), segments)
        number = np.arange(base[-1]) - base[row_of]
        name = mix((band[row_of].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(77))
        full = mix(sums ^ name)
        weight1 = number >= two[row_of]
        f = np.zeros(len(full), dtype=np.int64)
        if len(listed):
            where = np.searchsorted(listed, full)
            where[where == len(listed)] = 0
            f = np.where(listed[where] == full, often[where], 0)
        order = np.lexsort((full, -f, ~weight1, row_of))  # by row: weight 1 first, most frequent first
        rank = np.arange(len(full)) - base[row_of[order]]
        stay = order[~(weight1[order] & (rank < slack[row_of[order]]))]
        rows_out.append(rows[row_of[stay]])
        sig_out.append(full[stay])
        near = np.flatnonzero(seg < two[own])
        if len(near):
            rows_out.append(rows[own[near]])
            sig_out.append(mix((sums[key[near]] - value[at[near]]) ^ name[key[near]]))
    if not rows_out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(rows_out), np.concatenate(sig_out)


def signature_rows(docs: DataFrame, n: int, plan: dict, frequent: tuple, num: int, den: int) -> DataFrame:
    def run(batches):
        for batch, raw, offs in pieces(batches, "text"):
            h, first = sets_of(raw, offs, n)
            row, sig = signatures(h, first, plan, frequent, num, den)
            order = np.lexsort((sig, row))
            row, sig = row[order], sig[order]
            again = np.zeros(len(row), dtype=bool)
            again[1:] = (row[1:] == row[:-1]) & (sig[1:] == sig[:-1])
            row, sig = row[~again], sig[~again]
            yield pa.RecordBatch.from_arrays([batch.column(0), ragged(sig.view(np.int64), np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int64())], names=["doc_id", "sigs"])

    return docs.mapInArrow(run, "doc_id long, sigs array<long>")


def unpacked_sets(batches, n: int):
    """(ids, n-gram hashes by row, row offsets) of packed texts, about a megabyte of text at a time."""
    code = zstandard.ZstdDecompressor()
    for batch in batches:
        packed, lo = batch.column(1).to_pylist(), 0
        while lo < len(packed):
            held, size = [], 0
            while lo + len(held) < len(packed) and size < 1 << 20:
                held.append(code.decompress(packed[lo + len(held)]))
                size += len(held[-1])
            yield batch.column(0).slice(lo, len(held)), *sets_of(np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([0, *map(len, held)]), n)
            lo += len(held)


def crowded_rows(texts: DataFrame, n: int, frequent: tuple[np.ndarray, np.ndarray], num: int, den: int) -> DataFrame:
    """The second index, (doc_id, grams): the rarest n-grams of each packed text's set, rarest first.

    A set shares num / den of its n-grams' number or more with any linked one, so of one more than it
    can afford to lose, the rarest, one at least is shared.
    """
    listed, often = frequent

    def run(batches):
        for ids, h, first in unpacked_sets(batches, n):
            size = np.diff(first)
            f = np.zeros(len(h), dtype=np.int64)
            if len(listed):
                where = np.searchsorted(listed, h)
                where[where == len(listed)] = 0
                f = np.where(listed[where] == h, often[where], 0)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, f, row))
            rank = np.arange(len(h)) - first[row]
            most = size + (-num * size) // den + 1
            stay = rank < most[row]
            yield pa.RecordBatch.from_arrays([ids, ragged(h[order][stay].view(np.int64), np.concatenate([[0], np.cumsum(most)]), pa.int64())], names=["doc_id", "grams"])

    return texts.select("doc_id", "packed").mapInArrow(run, "doc_id long, grams array<long>")


def frequent_grams(texts: DataFrame, n: int, share) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of a sample of the texts, sorted, and their counts; they order n-grams and never change a result."""

    def run(batches):
        for _, h, _ in unpacked_sets(batches, n):
            grams, count = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(count, type=pa.int64())], names=["gram", "n"])

    counted = texts.filter(share).select("doc_id", "packed").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = materialize(counted.filter("n > 1").orderBy(F.desc("n"), "gram").limit(FREQUENT), "frequent-grams").collect()
    return _sorted_counts([(r["gram"], r["n"]) for r in top])


def _sorted_counts(rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((v & ((1 << 64) - 1), n) for v, n in rows)
    return np.array([v for v, _ in rows], dtype=np.uint64), np.array([n for _, n in rows], dtype=np.int64)


def _share(rows: int, wanted: int = SAMPLE_SETS):
    """A condition on doc_id that about ``wanted`` of so many rows meet."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, rows)))


def crossing(member: DataFrame) -> DataFrame:
    """Of each signature whose sets lie in several components: how many sets, and how many pairs of different components."""
    roots = member.groupBy("s", "root").agg(F.count(F.lit(1)).alias("n"))
    both = ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")
    return roots.groupBy("s").agg(F.sum("n").alias("n"), both).filter("pairs > 0")


def cross_pairs(member: DataFrame, fits=None) -> DataFrame:
    """Pairs (a, b), a < b, of one signature's sets that lie in different components; ``fits`` is a further condition on both.

    Spark takes the conditions into the join, so only pairs that meet them become rows.
    """
    other = [c for c in member.columns if c != "s"]
    x, y = (member.select("s", *[F.col(c).alias(f"{k}_{c}") for c in other]) for k in ("x", "y"))
    both = x.join(y, "s").filter("x_root < y_root")
    both = both if fits is None else both.filter(fits)
    return both.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def centre_pairs(member: DataFrame, first: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a < b, of each signature's sets with ``CENTRES`` of them, drawn by hash, of other components; of pairs that may be similar."""
    drawn = [F.min(F.struct(F.xxhash64("doc_id", F.lit(first + k)).alias("h"), "doc_id", "root", "n", "bits")) for k in range(CENTRES)]
    centres = member.groupBy("s").agg(F.array(*drawn).alias("centres"))
    own = F.struct("n", "bits")
    fit = F.filter("centres", lambda c: (c["root"] != F.col("root")) & alike(own, c, num, den))
    both = member.join(centres, "s").select("doc_id", F.explode(fit).alias("c"))
    return both.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("x")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("y")), "b").select("a", "b", "x", "y")

    def linked(held: list[bytes]) -> list[bool]:
        h, first = sets_of(np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([0, *map(len, held)]), n)
        size = np.diff(first)
        out = []
        for i in range(0, len(held), 2):
            shared = len(np.intersect1d(h[first[i]:first[i + 1]], h[first[i + 1]:first[i + 2]], assume_unique=True))
            out.append(bool(shared * den >= (size[i] + size[i + 1] - shared) * num))
        return out

    def run(batches):
        code = zstandard.ZstdDecompressor()
        for batch in batches:
            held, size, answers = [], 0, []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                held += [code.decompress(x.as_py()), code.decompress(y.as_py())]
                size += len(held[-1]) + len(held[-2])
                if size > 1 << 20:
                    answers += linked(held)
                    held, size = [], 0
            answers += linked(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(answers, type=pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    about = materialize(describe(docs, n), "gram-sets")
    same = ["n_shingles", "h1", "h2"]
    classes = materialize(about.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits")), "set-classes")
    reps = classes.filter("rep is not null").select(F.col("rep").alias("doc_id"), "n_shingles", "bits").dropDuplicates(["doc_id"])

    band = F.lit(-1)
    for i, e in enumerate(BANDS[:-1].tolist()):
        band = F.when(F.col("n_shingles") >= e, i).otherwise(band)
    sizes = {r["band"]: r["n"] for r in reps.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = {}
    for b in sizes:
        for k in range(3):
            if 0 <= b and b + k < len(BANDS) - 1:
                plan[b + k] = allocate(int(BANDS[b + k]), int(BANDS[b + k + 1]), sum(sizes.get(b + k - j, 0) for j in range(2)), num, den)
    plan = {b: p for b, p in plan.items() if p[0] + p[1]}

    total = sum(sizes.values())
    none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    sample = signature_rows(docs.filter(_share(total)), n, {b: (p[0], p[1], 0) for b, p in plan.items()}, none, num, den)
    top = sample.select(F.explode("sigs").alias("s")).groupBy("s").count().filter("count >= 3").orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    frequent = _sorted_counts([(r["s"], r["count"]) for r in top])

    sigs = signature_rows(docs, n, plan, frequent, num, den).join(reps.select("doc_id"), "doc_id").select(F.explode("sigs").alias("s"), "doc_id")
    w = Window.partitionBy("s")
    met = sigs.select("s", "doc_id", F.min("doc_id").over(w).alias("low"), F.max("doc_id").over(w).alias("high")).filter("low < high").select("s", "doc_id", "low")
    met = materialize(met, "met")
    del sigs, sample
    free_shuffles(docs)

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The linked pairs among candidates, verified on the texts of those that size and parity leave."""
        left = materialize(possible(pairs, reps, num, den), f"{name}-possible")
        ends = left.select("a").union(left.select("b")).distinct().select(F.col("a").alias("doc_id"))
        texts = materialize(texts_of(docs, ends), f"{name}-texts")
        free_shuffles(docs)
        return materialize(_verified(left, texts, n, num, den), f"{name}-links")

    stars = materialize(met.filter("doc_id != low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    links = linked(stars, "star")
    roots = materialize(components(links), "star-roots")

    # the n-grams a second index has of a set, and of all sets of a signature that makes more pairs than it has sets
    again = F.col("n_shingles") - F.ceil(num * F.col("n_shingles") / den) + 1

    def placed(roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(sets of every signature with their components, signatures across components, those too large to pair all their sets)."""
        root = F.coalesce("root", "doc_id").alias("root")
        member = materialize(met.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("s", "doc_id", root), "members")
        across = materialize(crossing(member), "crossing")
        busy = member.join(across.filter(F.col("pairs") > PAIRS_A_GRAM * F.col("n")).select("s", "pairs"), "s").join(reps.select("doc_id", "n_shingles"), "doc_id")
        large = busy.groupBy("s", "pairs").agg(F.sum(again).alias("grams")).filter(F.col("pairs") > PAIRS_A_GRAM * F.col("grams")).select("s", "pairs")
        return member, across, materialize(large, "crowded-signatures")

    face = faces(reps, fineness(num, den))
    member, across, large = placed(roots)
    tried = stars
    for k in range(ROUNDS):
        if (large.agg(F.sum("pairs")).first()[0] or 0) <= total:  # the second index pairs them as cheaply
            break
        pairs = centre_pairs(member.join(large, "s", "left_semi").join(face, "doc_id"), k * CENTRES, num, den)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "centre-pairs")
        found = linked(pairs, "centre")
        tried = tried.unionByName(pairs)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        roots = materialize(components(links), "centre-roots")
        member, across, large = placed(roots)
    few = member.join(across.select("s"), "s").join(large, "s", "left_anti").join(face, "doc_id")
    rest = cross_pairs(materialize(few, "rest-members"), alike("x", "y", num, den))
    crowd = member.join(large, "s", "left_semi").select("doc_id", "root").distinct()
    crowd = materialize(crowd.join(face, "doc_id"), "crowded")
    crowded = crowd.count()
    if crowded:
        texts = materialize(texts_of(docs, crowd.select("doc_id")), "crowded-texts")
        grams = crowded_rows(texts, n, frequent_grams(texts, n, _share(crowded, GRAM_SETS)), num, den).join(crowd, "doc_id")
        grams = grams.select("doc_id", "root", "n", "bits", F.posexplode("grams").alias("at", "s"))
        member = materialize(grams.select("s", "doc_id", "root", "n", "bits", "at"), "crowded-members")
        # linked sets share so many n-grams; the rarest of these stands in front of the others in both sets
        shared = f"(({num} * (x_n + y_n) + {num + den - 1}) div {num + den})"
        fits = F.expr(f"x_at <= x_n - {shared} and y_at <= y_n - {shared}") & alike("x", "y", num, den)
        rest = rest.unionByName(cross_pairs(member.join(crossing(member).select("s"), "s"), fits)).distinct()
    more = linked(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    roots = components(links.unionByName(more))

    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("root", "rep").alias("component_id"))
    named = named.withColumnsRenamed({c: f"k_{c}" for c in same})
    on = [F.col(c) == F.col(f"k_{c}") for c in same]
    return about.join(named, on, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
