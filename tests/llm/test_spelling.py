"""Spelling variants against a plain program, with small parts so that every way of finding pairs is taken."""
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import queries as Q
from tessera.llm.spelling import Acceptor, near_words, variants

from .common import FOLD, SF

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(docs):
    n = Counter()
    for d, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(FOLD)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_near(words):
    """All near words of each word; candidates by one letter left out."""
    keys = defaultdict(set)
    for w in words:
        keys[w].add(w)
        for i in range(len(w)):
            keys[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for held in keys.values():
        for a in held:
            near[a] |= {b for b in held if b not in near[a] and a != b and is_near(a, b)}
    return near


def brute(docs):
    n = brute_words(docs)
    near, form = brute_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def columns(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("seed", range(20))
def test_acceptor_pairs(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randrange(r.choice([1, 5]), 8))) for _ in range(r.choice([2, 30, 200]))} | ({""} if seed % 3 == 0 else set()))
    machine = Acceptor(words)
    assert machine.count[machine.initial] == len(words)
    got = [tuple(sorted(p)) for p in machine.pairs()]
    want = {(i, j) for j in range(len(words)) for i in range(j) if is_near(words[i], words[j])}
    assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal():
    """Words with common endings share their states; a long word needs no recursion."""
    assert len(Acceptor(sorted(a + b for a in "abcdefgh" for b in ("ing", "ings", "ed"))).final) == 7
    assert list(Acceptor(["a" * 40_000, "a" * 40_001]).pairs()) == [(1, 0)]


@pytest.mark.parametrize("most", [20_000, 30, 1])
def test_near_words(spark, most):
    """Parts of every size: all composed, some split further, all by left-out letters."""
    r = random.Random(most)
    words = {"".join(r.choice("aabcé") for _ in range(r.randrange(5, 8))) for _ in range(900)} | {"prefix" * 3 + "".join(r.choice("xyz") for _ in range(4)) for _ in range(60)}
    n = {w: r.randrange(3, 9) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in near_words(df, most).collect()}
    near = brute_near(n)
    want = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            want[w] = (len(near[w]), best, n[best])
    assert got == want


EDGE = [(1, None), (2, ""), (3, "12 ,;"), (4, "Colour colour COLOUR color Color color color color color color"), (5, "naïve Naïve naïve naive NAÏVE naïve naïve naïve"), (None, "colours colours colours coloured"),
        (6, "x" * 70 + " " + "x" * 71), (7, ("x" * 70 + " ") * 400), (8, "y" * 3000 + " " + "y" * 3000 + " " + "y" * 3000 + " abcde×÷ÿ ÀBCDE àbcde "), (9, "same letters same letters"), (9, "same letters same letters"), (12, "chainaa " * 4 + "chainab " * 9 + "chainbb " * 19 + "chainbbs " * 40)]


def test_edges(spark):
    docs = EDGE + [(100 + i, "letters lettres leters colour coluor collour words wordsy naive naîve") for i in range(600)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string").repartition(5)
    got = columns(variants(df))
    assert got == brute(docs) and any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert columns(Q.QUERIES["op13_spelling"](spark, SF)) == brute(docs)


def test_empty_table(spark):
    assert variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
