"""Packing: the histogram against placing documents one by one, and whole round trips of the ids."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import queries as Q
from tessera.llm.packing import Places, pack, pack_histogram, shortest_pack_first

from .common import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(histogram, size):
    fills = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room = [i for i, f in enumerate(fills) if size - f >= length]
            if room:
                fills[min(room, key=lambda i: fills[i])] += length
            else:
                fills.append(length)
    return sorted(fills)


def check_sequences(sequences, size):
    """Gapless sequences; complete or a power of two long."""
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        n = spans[-1][1]
        assert n == size or 0 < n < size and n & (n - 1) == 0


@pytest.mark.parametrize("seed", range(60))
def test_histogram(seed):
    r = random.Random(seed)
    size = r.choice([8, 16, 32])
    histogram = {n: r.randrange(1, r.choice([2, 5, 40])) for n in r.sample(range(1, size), r.randrange(1, size))}
    packs = shortest_pack_first(histogram, size)
    assert sorted(size - p.gap for p in packs for _ in range(p.count)) == one_by_one(histogram, size)
    places, sequences = Places(pack_histogram(histogram, size)), defaultdict(list)
    for length, n in histogram.items():
        covered = defaultdict(list)
        for d, a, m, s, o in zip(*(x.tolist() for x in places.find(np.full(n, length), np.arange(n))), strict=True):
            covered[d].append((a, a + m))
            sequences[s].append((o, o + m))
        assert len(covered) == n
        for spans in covered.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == length and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    check_sequences(sequences, size)
    assert sorted(sequences) == list(range(places.sequences))
    assert sum(s[-1][1] < size for s in sequences.values()) <= size.bit_length() - 1


def whole_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(rows, docs, size):
    """docs: (doc_id, text) with the rows of one id holding equal texts."""
    ids, count, sequences, pieces = {}, defaultdict(int), defaultdict(list), defaultdict(list)
    for (d, _), x in zip(docs, whole_ids([t for _, t in docs]), strict=True):
        assert ids.setdefault(d, x) == x
        count[d] += 1
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    check_sequences(sequences, size)
    for d, own in ids.items():
        places = np.zeros(len(own), dtype=int)
        for a, m in pieces[d]:
            places[a:a + m] += 1
        assert (places == count[d]).all()
    assert set(pieces) == set(ids)
    assert sum(s[-1][1] for s in sequences.values()) == sum(len(ids[d]) * n for d, n in count.items())
    assert sum(s[-1][1] < size for s in sequences.values()) <= size.bit_length() - 1


EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "The  quick brown fox; CAN'T stop <|endoftext|> naïve é ́x ＷＩＤＥ 12345 \U0001f600\x00\x1c\x85"),
        (6, "word " * 5000), (7, "x" * 30_000), (8, "tie tie"), (8, "tie tie"), (9, "tie tie"), (None, "no id"), (None, "no id"), (10, "Σας ΟΔΟΣ ΟΔΟΣ. İstanbul ǅ")]


@pytest.mark.parametrize("size", [16, 2048])
def test_edges(spark, size):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in EDGE], "doc_id long, text string, tokens int, part string").repartition(3)
    check_pieces(pack(df, PATH, size=size).collect(), EDGE, size)


def test_hot_length(spark):
    """A third of the documents of one length, another third empty, in many partitions."""
    docs = [(i, "a b c d e" if i % 3 == 0 else "" if i % 3 == 1 else "w " * (i % 90)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    check_pieces(pack(df, PATH, size=64).collect(), docs, 64)


def test_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(Q.QUERIES["op11_packing"](spark, SF).collect(), docs, 2048)


def test_encoder_against_whole_texts():
    """Random strings of letters, signs, apostrophes, marks and special tokens, whole and cut into words."""
    from tessera.llm.packing import Encoder
    from tessera.llm.text import column_bytes
    r = random.Random(3)
    pieces = [*"aAbBzZ019 \t\n.,;:!?'\"-_/#<|>", "'s", "'LL", "don't", "É", "é", "\u0301", "\u0338", "ß", "Σ", "ς", "\u200d", "\U0001f600", "１", "\u00a0", "\u0085", "\x1c", "İ", "ﬁ"]
    for special in (False, True):
        texts = ["".join(r.choice(pieces + ["<|endoftext|>", "<|ENDOFTEXT|>"] * special) for _ in range(r.randrange(60))) for _ in range(800)]
        encoder = Encoder(PATH)
        import pyarrow as pa
        for part in (texts[:300], texts[300:]):
            raw, offs = column_bytes(pa.array(part, type=pa.string()))
            words = encoder.words(raw, offs)
            n, ids = encoder.encode(words)
            ends = np.concatenate([[0], np.cumsum(n)])[words.first]
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [x[:-1] for x in whole_ids(part)]


def test_wide_ids(spark):
    """A vocabulary of more than 65,536 ids is stored wide: the end id alone can ask for it."""
    rows = pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH, size=8, end_id=70_000).collect()
    assert sum(r["length"] for r in rows) == 3 == rows[0]["doc_tokens"]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
