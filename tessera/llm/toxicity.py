"""Toxicity by noisy-channel deobfuscation: Viterbi decoding of character lattices, then scoring the restored text.

Fitting uses a bounded sample of labelled rows (``sample_rows``). Distributed counts give the words
and word beginnings that stand in toxic texts mostly; near copies among the toxic texts are grouped by
min-hashes and count once, so the other words of a copied toxic text get no weight. The
character trigram model is counted over all texts and mixed with one of the kept words.

Scoring: a word written plainly is its own restoration. A word that holds a letter together with a
look-alike, an inner separator or a repeated character, and a run of single spaced characters, is a
noisy reading: its lattice is decoded if a path through it spells a kept word. The lattice offers for every character the letters it may stand for, or nothing for a separator or a
repetition, and the most probable paths under the character model are the restorations. A text's
score is one minus the product of its words' chances to be harmless.

Defined results: null and empty texts get the base rate of texts without any kept word; an empty
table gives no rows; without labels nothing is kept and every score is 0; repeated rows get equal
scores; labels with null are not learnt from; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package

from .text import mix, pieces, seeded

PREFIXES = (4, 5, 6, 7)
EDGE = " \t\n.,;:!?\"'()[]{}<>|/\\#*&%~`^=+-_"
# Signs and the letters they stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = set(" .-_*'`~/\\,")
_LETTER = re.compile(r"[^\W\d_]")
_NOISY = re.compile(r"[0-9@$!|+(€£¡]|[^\s.\-_*'`~/\\,][.\-_*'`~/\\,]+[^\s.\-_*'`~/\\,]|(.)\1")
#: Classes of the character model: blank and signs, a-z, one for digits, and 32 for the bytes of other characters.
CLASSES = 60
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[128:] = 28 + (np.arange(128, 256) & 31)


def crc_rest(key: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(parts))


def plain_words(text: str) -> list[str]:
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


def features(word: str) -> list[str]:
    return [word] + [f"{word[:k]}~" for k in PREFIXES if len(word) > k]


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    rows = labels.count()
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(1, rows)))
    some = labels.filter(keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.join(F.broadcast(some), "doc_id")  # about sample_rows rows of two numbers


def fit_words(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, least: int = 4, evidence: float = 12.0, purity: float = 0.9) -> tuple[dict[str, float], float]:
    """Kept words and word beginnings with their chance of a toxic text, and the base rate without them."""
    rows = _sample(docs, labels, sample_rows)

    def count(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch, _, _ in pieces(batches, "text"):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(plain_words(text or "")) for f in features(w)}:
                    seen[f][toxic] += 1
            if len(seen) > 500_000:
                yield _counted(seen)
                seen.clear()
        if seen:
            yield _counted(seen)

    labelled = rows.select("text", "toxic")
    totals = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = labelled.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    wanted = ((F.col("toxic") >= least) & (F.col("toxic") >= F.col("clean"))) | (F.col("clean") >= 0.02 * totals[0])
    seen = {r["feature"]: (r["clean"], r["toxic"]) for r in counted.filter(wanted).collect()}  # of a bounded sample
    common = {f for f, (c, _) in seen.items() if c >= 0.02 * totals[0]}
    pure = {f: ct for f, ct in seen.items() if ct[1] >= least and ct[1] >= ct[0]}

    def holders(batches):
        for batch, _, _ in pieces(batches, "text"):
            found, marks = [], []
            for t in batch.column(0).to_pylist():
                words = set(plain_words(t or ""))
                found.append(sorted({f for w in words for f in features(w) if f in pure}))
                marks.append(_marks([w for w in words if w not in common]))
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.list_(pa.string())), pa.array(marks, type=pa.list_(pa.int64()))], names=["found", "marks"])

    texts = labelled.filter("toxic = 1").select("text").mapInArrow(holders, "found array<string>, marks array<long>").collect()  # the sample's toxic rows
    return select([(r["found"], r["marks"]) for r in texts], pure, totals, evidence, purity)


def _marks(words: list[str]) -> list[int]:
    """Eight hashes of three min-hashes each of the rarer words; near copies share one or more."""
    if len(words) < 5:
        return []
    h = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64)
    low = np.array([seeded(h, 50 + k).min() for k in range(24)], dtype=np.uint64).reshape(8, 3)
    return mix(low[:, 0] + low[:, 1] * np.uint64(3) + low[:, 2] * np.uint64(7) + np.arange(8, dtype=np.uint64)).view(np.int64).tolist()


def _counted(seen: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], type=pa.int64()), pa.array([v[1] for v in seen.values()], type=pa.int64())],
                                      names=["feature", "clean", "toxic"])


def select(texts: list[tuple[list[str], list[int]]], pure: dict[str, tuple[int, int]], totals: dict[int, int], evidence: float, purity: float) -> tuple[dict[str, float], float]:
    """Features whose toxic texts, near copies counted once, are too many for chance, and the toxic share of texts with none.

    ``evidence`` is the log-likelihood ratio asked for against the sample's toxic share, about the
    logarithm of the number of features tried; ``purity`` is the least share of toxic texts.
    """
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[int, int] = {}
    for i, (_, marks) in enumerate(texts):
        for m in marks:
            root[find(i)] = find(first.setdefault(m, i))
    holders: dict[str, set[int]] = defaultdict(set)
    for i, (found, _) in enumerate(texts):
        for f in found:
            holders[f].add(find(i))
    share = totals[1] / max(1, sum(totals.values()))
    kept: dict[str, float] = {}
    for f, groups in holders.items():
        toxic, clean = len(groups), pure[f][0]
        p = toxic / (toxic + clean)
        gain = toxic * math.log(p / share) + (clean * math.log((1 - p) / (1 - share)) if clean else 0.0)
        if p > share and p >= purity and gain >= evidence:
            kept[f] = (toxic + share) / (toxic + clean + 1.0)
    missed = sum(1 for found, _ in texts if not any(f in kept for f in found))
    return kept, missed / max(1, totals[0] + missed) if texts else 0.0


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of character classes over all texts (``CLASSES`` cubed cells, summed by Spark)."""

    def count(batches):
        total = np.zeros(CLASSES ** 3, dtype=np.int64)
        for _, raw, _ in pieces(batches, "text"):
            c = _CLASS[raw]
            if len(c) > 2:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(CLASSES ** 3, dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


class Decoder:
    """Restores noisy readings under the character model; ``best`` gives the most probable strings."""

    def __init__(self, counts: np.ndarray, kept: dict[str, float], share: float = 0.4, beam: int = 24):
        self.beam = beam
        own = np.zeros(CLASSES ** 3)
        for f in kept:
            c = self.codes(f" {f.rstrip('~')}" + ("" if f.endswith("~") else " "))
            for a, b, d in zip([0, *c], c, c[1:], strict=False):
                own[(a * CLASSES + b) * CLASSES + d] += 1
        self.logp = np.log((1 - share) * self._smooth(counts.astype(float), 0.5) + share * self._smooth(own, 0.01))

    @staticmethod
    def codes(s: str) -> list[int]:
        return [int(_CLASS[b]) for b in s.encode()]

    @staticmethod
    def _smooth(n: np.ndarray, weight: float) -> np.ndarray:
        """Trigram estimates, backed off to bigrams and to the uniform distribution."""
        cube = n.reshape(CLASSES, CLASSES, CLASSES)
        two = cube.sum(axis=0)
        p2 = (two + weight / CLASSES) / (two.sum(axis=1, keepdims=True) + weight)
        return ((cube + weight * p2[None]) / (cube.sum(axis=2, keepdims=True) + weight)).reshape(-1)

    def readings(self, s: str, i: int) -> list[tuple[str, float]]:
        """What character i may stand for, with its log-probability in the channel."""
        c = s[i]
        out = []
        again = i > 0 and s[i - 1] == c
        if c.isalpha():
            out.append((c, -0.3 if again else 0.0))
            if again:
                out.append(("", -0.5))
        else:
            if c in SEPARATORS:
                out += [("", -0.7), (" ", -1.2)]
            elif not c.isdigit():
                out.append((" ", -2.5))
            for x in LOOKALIKES.get(c, ""):
                out.append((x, -1.0))
            if again:
                out.append(("", -0.7))
            if not out:
                out.append((c, -2.0))
        return out

    def best(self, s: str, n: int = 3) -> list[str]:
        paths = {(0, 0): (0.0, None)}  # last two classes: score and the linked characters so far
        logp = self.logp
        for i in range(len(s)):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, text) in paths.items():
                for x, cost in self.readings(s, i):
                    v, p, q = score + cost, a, b
                    for code in self.codes(x):
                        v += logp[(p * CLASSES + q) * CLASSES + code]
                        p, q = q, code
                    known = step.get((p, q))
                    if known is None or v > known[0]:
                        step[(p, q)] = (v, (text, x) if x else text)
            paths = dict(heapq.nlargest(self.beam, step.items(), key=lambda kv: kv[1][0])) if len(step) > self.beam else step
        ends = heapq.nlargest(n, ((v + logp[(a * CLASSES + b) * CLASSES], t) for (a, b), (v, t) in paths.items()), key=lambda vt: vt[0])
        out = []
        for _, linked in ends:
            chars = []
            while linked is not None:
                linked, x = linked
                chars.append(x)
            out.append("".join(reversed(chars)))
        return out


class Spelled:
    """Whether some path through a reading's lattice spells a kept word or word beginning, from a tree of their letters."""

    def __init__(self, kept: dict[str, float], readings):
        self.readings = readings
        self.root: dict = {}
        for f in kept:
            node = self.root
            for c in f.rstrip("~"):
                node = node.setdefault(c, {})
            node[""] = {}

    def __call__(self, s: str) -> bool:
        nodes: dict[int, dict] = {}
        for i in range(len(s)):
            after: dict[int, dict] = {}
            for x, _ in self.readings(s, i):
                if not x:
                    after |= nodes
                elif x != " ":
                    for node in (self.root, *nodes.values()):
                        to = node.get(x)
                        if to is not None:
                            if "" in to:
                                return True
                            after[id(to)] = to
            nodes = after
        return False


class Scorer:
    """Chance of toxicity of whole texts; word results are remembered up to a fixed number."""

    def __init__(self, kept: dict[str, float], base: float, counts: np.ndarray, remember: int = 1 << 17):
        self.kept, self.base, self.remember = kept, base, remember
        self.decoder = Decoder(counts, kept) if kept else None
        self.spelled = Spelled(kept, self.decoder.readings) if kept else None
        self.known: dict[str, float] = {}

    def _plain(self, word: str) -> float:
        return max((self.kept.get(f, 0.0) for f in features(word)), default=0.0)

    def restored(self, reading: str, spaced: bool = False) -> float:
        """Strongest word of the most probable restorations. Spaced characters may have lost their word
        borders, so there a kept word may stand anywhere."""
        best = self.decoder.best(reading)
        found = max((self._plain(w) for s in best for w in plain_words(s)), default=0.0)
        if spaced:
            joined = [s.replace(" ", "") for s in best]
            found = max(found, max((p for f, p in self.kept.items() if len(f) > 3 and f[-1] != "~" and any(f in s for s in joined)), default=0.0))
        return found

    def word(self, raw: str) -> float:
        w = raw.strip(EDGE)
        p = self._plain(w) if w else 0.0
        if not p and len(raw) > 2 and _LETTER.search(raw) and _NOISY.search(raw):
            inner = raw.strip(" \t\n\"()[]{}<>")
            opened = f"({inner}" if raw.lstrip(" \t\n\"[]{}<>").startswith("(") else ""  # it may stand for a letter
            p = max((self.restored(x) for x in (inner, opened) if x and self.spelled(x)), default=0.0)
        if len(self.known) >= self.remember:
            self.known.clear()
        self.known[raw] = p
        return p

    def text(self, text: str | None) -> float:
        if not self.kept or not text:
            return self.base if self.kept else 0.0
        harmless = 1.0 - self.base
        words = text.lower().split()
        known = self.known
        hits = {}
        for w in set(words):
            p = known.get(w)
            if p is None:
                p = self.word(w)
            if p:
                hits[w.strip(EDGE)] = p
        lengths = list(map(len, words))
        if lengths.count(1) > 2:
            at = 0
            for single, group in itertools.groupby(lengths, key=(1).__eq__):
                n = sum(1 for _ in group)
                if single and n > 2:
                    reading = " ".join(words[at:at + n])
                    p = known.get(reading)
                    if p is None:
                        p = self.restored(reading, spaced=True) if len(set(words[at:at + n])) > 1 else 0.0
                        if len(known) >= self.remember:
                            known.clear()
                        known[reading] = p
                    if p:
                        hits[reading] = p
                at += n
        for p in hits.values():
            harmless *= 1.0 - p
        return min(1.0, max(0.0, 1.0 - harmless))


def score_texts(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, cut: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; learns from ``labels`` (doc_id, toxic) alone, which the caller restricts."""
    ship_package(docs.sparkSession)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    kept, base = fit_words(own, labels, sample_rows)
    counts = char_counts(own) if kept else np.zeros(CLASSES ** 3, dtype=np.int64)
    columns = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        scorer = Scorer(kept, base, counts)
        for batch, _, _ in pieces(batches, "_scored"):
            scores = [scorer.text(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, type=pa.float64())], names=[*batch.schema.names[:-1], "score"])

    given = docs.select(*columns)
    schema = given.schema.add("score", "double")
    out = given.withColumn("_scored", F.col("text").cast("string")).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
