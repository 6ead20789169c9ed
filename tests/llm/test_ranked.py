"""Ranked search against a plain scorer, with ties, hot classes and several item blocks."""
import math
from collections import Counter

import pytest

from tessera.llm.ranked import search

from .common import alnum_words, some_words

EDGE = [(1, None), (2, ""), (3, " ,;! "), (4, "Apple pie"), (5, "apple PIE pie"), (5, "apple PIE pie"), (6, "pie apple"), (7, "apple " * 30_000), (None, "pie apple"), (8, "unrelated words"),
        (9, "naïve café Apple"), (10, "x-apple_pie.tart 42")]
ITEMS = [("a", "apple pie"), ("b", "Apple apple, APPLE"), ("c", None), ("d", ""), ("e", "nothing here"), ("a", "tart 42 café"), (None, "apple pie"), ("f", "pie")]


def brute(docs, items, top):
    words = [(d, Counter(alnum_words(t))) for d, t in docs if alnum_words(t)]
    n, total = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in words:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in alnum_words(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def frames(spark, docs, items, parts=4):
    return (spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, bag string").repartition(parts),
            spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id string, text string, q int, rank int"))


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
@pytest.mark.parametrize("top", [2, 10])
def test_edges(spark, top, block_bytes):
    got = search(*frames(spark, EDGE, ITEMS), top=top, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(EDGE, ITEMS, top)


def test_hot_classes(spark):
    """A third of the rows in one class, another third near copies in a few; ties are cut by the smallest ids."""
    docs = [(997 * i % 3000, "w1 w2 w3" if i % 3 == 0 else f"w{i % 5} w7 w7" if i % 3 == 1 else " ".join(some_words(30, i, 60))) for i in range(3000)]
    items = [(str(k), " ".join(some_words(8, 10_000 + k, 60))) for k in range(30)] + [("hot", "w1 w2")]
    assert sorted(map(tuple, search(*frames(spark, docs, items, 16)).collect()), key=str) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = frames(spark, EDGE, ITEMS)
    assert search(docs.limit(0), items).count() == 0 and search(docs, items.limit(0)).count() == 0
    assert search(docs.limit(0), items).columns == search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
