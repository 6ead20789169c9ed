"""Jaccard join, repeated passages and benchmark leaks against brute force."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.decontaminate import find_leaks, leak_digest
from tessera.llm.graph import components
from tessera.llm.jaccard_join import alike, allocate, describe, faces, most_apart, similar_components
from tessera.llm.substrings import _token_list, common_passages, repeated_passages

from .common import SF, alnum_words, blank_words, groups, some_words


def grams(text, n=4):
    w = blank_words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def edited(words, changes, seed):
    r = random.Random(seed)
    out = list(words)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Sets of every size with edits around the threshold, exact copies, a shared line, and edge cases."""
    rows, i = [], 0
    line = " ".join(f"shared{k}" for k in range(9))
    for size in (1, 2, 3, 4, 5, 7, 9, 12, 18, 25, 40, 60, 90, 140, 250, 400):
        base = some_words(size, size)
        for k in range(7):
            w = edited(base, k * max(1, size // 160), 100 * size + k)
            rows.append((i, (line + "\n" if k == 3 else "") + " ".join(w)))
            i += 1
        rows.append((i, " ".join(base).upper()))
        i += 1
        rows.append((i, " ".join(base[:-1])))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "é ü"), (i + 4, "É ü"), (i + 5, "é  ü")]
    rows.append((i + 6, " ".join(some_words(30_000, 5, 5000))))
    rows.append((i + 7, " ".join(edited(some_words(30_000, 5, 5000), 300, 6))))
    return rows


def brute_components(rows, n=4, num=85, den=100):
    sets = {i: grams(t, n) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            u, v = sets[a], sets[b]
            if u and v and min(len(u), len(v)) * den >= num * max(len(u), len(v)):
                k = len(u & v)
                if den * k >= num * (len(u) + len(v) - k):
                    links.append((a, b))
    return sets, groups(ids, links)


def test_jaccard_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], "doc_id long, text string, grams string, n_shingles int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(df).collect()}
    sets, want = brute_components(corpus)
    assert got == {i: (len(sets[i]), want[i]) for i in want}


@pytest.mark.parametrize("n,num,den,pairs", [(4, 85, 100, 1.0), (4, 85, 100, 0.0), (5, 8, 10, 0.02)])
def test_jaccard_crowds(spark, monkeypatch, n, num, den, pairs):
    """Copies of one text with a few words changed, most of them too far from each other, and one line in a third
    of the rows: the sets that meet by chance are indexed once more, and no link is lost."""
    from tessera.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "PAIRS_A_GRAM", pairs)
    r = random.Random(41)
    base, line = some_words(150, 42, 10**6), some_words(40, 43, 10**6)
    texts = []
    for i in range(260):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 3, 3, 4, 5, 8])):
            w[r.randrange(len(w))] = f"new{i}-{r.randrange(10**6)}" if r.random() < 0.7 else r.choice(base)
        texts.append(w)
        if i % 9 == 0:  # a child of a far copy is linked with it alone
            child = list(w)
            child[r.randrange(len(w))] = f"child{i}"
            texts.append(child + some_words(r.randrange(3), i, 10**6))
    for i in range(150):
        own = some_words(r.randrange(1, 30), 1000 + i, 10**6)
        texts.append(own[: len(own) // 2] + line + own[len(own) // 2:])
    r.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets, comp = brute_components(rows, n, num, den)
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, num, den).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == {i: (len(sets[i]), comp[i]) for i, _ in rows}
    assert 60 < len(set(comp.values())) < len(rows)


def test_jaccard_other_threshold(spark, corpus):
    some = corpus[40:110]
    got = {r["doc_id"]: r["component_id"] for r in similar_components(spark.createDataFrame(some, "doc_id long, text string"), n=5, num=8, den=10).collect()}
    sets = {i: grams(t, 5) for i, t in some}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert got == groups(ids, links)


def test_jaccard_faces_keep_linked_pairs(spark):
    """Folded parity bits and sizes leave every pair that reaches the similarity, also where rows of bits differ in length; most others go."""
    r = random.Random(11)
    base = {k: [f"v{r.randrange(10**9)}" for _ in range(k)] for k in (5, 40, 70, 130, 260, 530, 2100)}
    texts = []
    for k, words in base.items():
        texts += [words, words[:-max(1, k // 50)], words + [f"n{i}" for i in range(k // 9)], words[: k // 2] + [f"o{k}{i}" for i in range(k // 2)]]
        texts.append([f"p{k}{i}" for i in range(k)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i:i + 4]) for i in range(len(t) - 3)} for t in texts]
    face = faces(describe(docs, 4)).cache()
    assert all(64 * len(x["bits"]) <= max(64, x["n"]) < 128 * len(x["bits"]) for x in face.collect() if x["n"] >= 64)
    x, y = (face.select(*[F.col(c).alias(f"{k}_{c}") for c in face.columns]) for k in ("x", "y"))
    left = {(p[0], p[1]) for p in x.crossJoin(y).filter("x_doc_id < y_doc_id").filter(alike("x", "y", 85, 100)).select("x_doc_id", "y_doc_id").collect()}
    every = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    linked = {(i, j) for i, j in every if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert len(linked) >= 12 and linked <= left and len(left - linked) < 0.1 * len(every - linked)


def test_jaccard_nulls_repeats_empty(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "lonely words here now"), (7, None)]
    got = sorted((str(r[0]), r[1], str(r[2])) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("None", 3, "3"), ("3", 3, "3"), ("3", 3, "3"), ("None", 1, "None"), ("7", 0, "7")])
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pigeonhole_bound():
    for total in range(2, 400):
        worst = max(t - 2 * s for t in range(2, total + 1) for s in (-(-85 * t // 185),))
        assert most_apart(total, 85, 100) == worst
    for low, high in ((8, 12), (40, 60), (1000, 1500)):
        one, two, slack = allocate(low, high, 1000, 85, 100)
        assert one + 2 * two >= most_apart(2 * (high - 1), 85, 100) + 1 + slack


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for p in links for n in p if p[0] != p[1]}
    assert got == groups(sorted(nodes), [p for p in links if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages(spark):
    passage, other = some_words(70, 1, 10**6), some_words(60, 2, 10**6)
    near = list(passage)
    near[30] = "changed"
    alone = lambda n, s: some_words(n, s, 10**7)
    line = some_words(9, 77, 10**6)
    rows = [(0, alone(300, 10) + passage + alone(100, 11)), (1, alone(40, 12) + passage), (2, alone(90, 13) + near + alone(500, 14)), (3, other + alone(20, 15)), (4, alone(7, 16) + other),
            (5, alone(400, 17)), (6, passage[:40] + alone(200, 18)), (7, alone(100, 21) + line), (8, line + alone(130, 22)), (9, alone(60, 23) * 2)]
    rows = [(i, " ".join(w)) for i, w in rows] + [(20, None), (21, ""), (None, " ".join(passage)), (30, "a " * 30_000), (31, "a " * 200)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, hash int, key int")
    got = {}
    for r in repeated_passages(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["stop_word"], r["class_id"], r["class_docs"]))
    assert set(got) >= {0, 1, 2, 3, 4} and not set(got) & {5, 6, 7, 8, 9, 20, 21, None}
    assert got[0] == [(300, 370, "0:300", 3)] and got[1] == [(40, 110, "0:300", 3)] and got[2][0][2] == "0:300"
    assert got[3] == [(0, 60, "3:0", 2)] and got[4] == [(7, 67, "3:0", 2)]


def test_passages_table_recall(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, need = {}, {}
    for r in docs.collect():
        w = blank_words(r["text"])
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i:i + 50]), set()).add((r["doc_id"], i))
    for v in seen.values():
        if len({d for d, _ in v}) > 1:
            for d, i in v:
                need.setdefault(d, set()).update(range(i, i + 50))
    got = {}
    for r in repeated_passages(docs).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["stop_word"]))
    for d, at in need.items():
        assert at <= got.get(d, set())
    assert repeated_passages(docs.limit(0)).count() == 0


def brute_leaks(docs, bench, n=10):
    wins = {}
    for item, text in bench:
        w = alnum_words(text)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[s:s + n]), set()).add(item)
    out = []
    for d, text in docs:
        w = alnum_words(text)
        hit, items = set(), set()
        for size in {len(k) for k in wins}:
            for s in range(len(w) - size + 1):
                found = wins.get(tuple(w[s:s + size]))
                if found:
                    hit.update(range(s, s + size))
                    items |= found
        names = ",".join(sorted(str(i) for i in items if i is not None))
        out.append((d, len(w), len(hit), len(items - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_leaks_brute_force(spark, block_bytes):
    items = [some_words(30, 50 + i, 60) for i in range(5)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(10, None), (11, ""), (12, "!!"), (13, "short item"), (None, " ".join(items[0][:12])), (2, " ".join(items[2])), (120, "Short, ITEM")]
    docs = [(0, None), (1, ""), (2, " ".join(items[0])), (3, "a short item b short, ITEM"), (4, " ".join(some_words(40, 9, 60) + items[1][5:15] + items[1][5:14])),
            (5, " ".join(items[3][:9])), (6, "é ".join(items[4])), (8, " ".join(some_words(20_000, 8, 60) + items[4])), (8, " ".join(items[2][3:])), (None, " ".join(items[1]))]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, n_words int, items string")
    got = find_leaks(df, spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block_bytes)
    rows = [tuple(r)[:6] for r in leak_digest(got).collect()]
    assert sorted(rows, key=str) == sorted(brute_leaks(docs, bench), key=str)


def test_leaks_by_row_in_blocks(spark):
    """Rows with a null or repeated id are kept apart in every number of blocks, and item texts repeat within one."""
    items = [some_words(30, 50 + i, 60) for i in range(5)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(100 + i, " ".join(items[0])) for i in range(60)] + [(None, " ".join(items[0])), (9, None)]
    docs = [(8, " ".join(items[4])), (8, " ".join(items[2][3:])), (8, " ".join(items[2][3:])), (None, " ".join(items[1])), (None, None), (None, " ".join(items[0])), (1, "clean")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    test = spark.createDataFrame(bench, "item_id long, text string")
    for block_bytes in (1 << 20, 300, 100):
        rows = [tuple(r)[:6] for r in leak_digest(find_leaks(df, test, block_bytes=block_bytes)).collect()]
        assert sorted(rows, key=str) == sorted(brute_leaks(docs, bench), key=str)


def test_leaks_near_and_empty(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "beta alpha x delta y gamma epsilon zeta"), (1, "alpha beta"), (2, "alpha " + "w " * 200 + "beta gamma delta")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in find_leaks(docs, bench).collect()} == {0: (0, 1), 1: (0, 0), 2: (0, 0)}
    assert find_leaks(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in find_leaks(docs, bench.limit(0)).collect()} == {0}


def test_passages_from_frequent_phrases(spark):
    """Every shingle of the equal passages also stands in an earlier document, so no hash function pairs the two with each other at first."""
    rows, want = [], []
    for k in range(4):
        passage = some_words(60, 900 + k, 10**6)
        alone = lambda n, s, k=k: some_words(n, 5000 + 100 * k + s, 10**7)
        rows += [(100 * k + j, alone(60, j) + passage[10 * j:10 * j + 14] + alone(60, 20 + j)) for j in range(6)]
        rows += [(100 * k + 50, alone(80, 40) + passage + alone(70, 41)), (100 * k + 51, alone(90, 42) + passage)]
        want += [(100 * k + 50, 80, 140), (100 * k + 51, 90, 150)]
    got = {(r["doc_id"], r["start_word"], r["stop_word"]) for r in repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert got == set(want)


def test_passages_of_edited_copies(spark):
    """Chains a ~ b ~ c in which a and c are not similar are one class."""
    rows = []
    for k in range(12):
        a = some_words(60, 300 + k, 10**6)
        b = [*a[:20], f"x{k}", *a[21:]]
        rows += [(10 * k, a), (10 * k + 1, b), (10 * k + 2, [*b[:40], f"y{k}", *b[41:]])]
    got = {}
    for r in repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect():
        got.setdefault(r["class_id"].split(":")[0], set()).add(r["doc_id"])
    assert got == {str(10 * k): {10 * k, 10 * k + 1, 10 * k + 2} for k in range(12)}


def test_passage_beside_repeated_lines():
    passage, line = some_words(60, 1, 10**6), some_words(10, 2, 10**6)
    x, y = (_token_list(" ".join(passage + some_words(40, s, 10**7) + line * 60).encode()) for s in (3, 4))
    found = common_passages(x, y, [(20, np.array([20]))], 46, 0.8)
    assert len(found) == 1 and found[0][0] == found[0][2] == 0 and found[0][1] == found[0][3] >= 56
    sx, sy = set(x[:found[0][1]].tolist()), set(y[:found[0][3]].tolist())
    assert len(sx & sy) >= 0.8 * len(sx | sy)


def test_jaccard_centre_pairs_in_proportion(spark):
    """A crowded signature's near copies are first paired with a few of them: pairs in proportion to its sets, each set of another component tried."""
    from tessera.llm.jaccard_join import CENTRES, centre_pairs, cross_pairs
    base = some_words(150, 71, 10**6)
    rows = [(i, " ".join([*base[:i % 150], f"new{i}", *base[i % 150 + 1:]])) for i in range(200)]
    rows.append((500, " ".join(some_words(150, 72, 10**6))))
    face = faces(describe(spark.createDataFrame(rows, "doc_id long, text string"), 5))
    member = face.select(F.lit(1).alias("s"), "doc_id", F.col("doc_id").alias("root"), "n", "bits").cache()
    pairs = [(x["a"], x["b"]) for x in centre_pairs(member, 0, 8, 10).collect()]
    assert len(pairs) == len(set(pairs)) <= CENTRES * 200 and all(a < b < 500 for a, b in pairs)
    assert {i for p in pairs for i in p} == set(range(200))
    assert cross_pairs(member, alike("x", "y", 8, 10)).count() == 200 * 199 // 2
    assert centre_pairs(member.withColumn("root", F.lit(0)), 0, 8, 10).count() == 0


def test_jaccard_faces_fine_enough(spark):
    """At a similarity of 0.8 unrelated sets are told apart by the bits that signatures carry, also just below a doubling of their size."""
    from tessera.llm.jaccard_join import fineness
    rows = [(i, " ".join(some_words(131, 100 + i, 10**9))) for i in range(60)]
    face = faces(describe(spark.createDataFrame(rows, "doc_id long, text string"), 5), fineness(8, 10)).cache()
    x, y = (face.select(*[F.col(c).alias(f"{k}_{c}") for c in face.columns]) for k in ("x", "y"))
    assert x.crossJoin(y).filter("x_doc_id < y_doc_id").filter(alike("x", "y", 8, 10)).count() <= 5
    assert fineness(85, 100) == 1


def test_passage_pairs_beside_a_common_line(spark, monkeypatch):
    """Texts that share one line alone, and a single repeated word too short for a passage, are never paired; edited copies among them are found."""
    from tessera.llm import substrings
    line = some_words(12, 31, 10**6)
    rows = [(i, line + some_words(90, 7000 + i, 10**7)) for i in range(60)]
    rows += [(100 + i, some_words(20, 8000 + i, 10**7) + ["again"] * 40 + some_words(60, 8100 + i, 10**7)) for i in range(20)]
    for k in range(4):
        copy = line + some_words(80, 9000 + k, 10**7)
        rows += [(200 + 10 * k + j, [*copy[:40 + j], f"new{j}", *copy[41 + j:]]) for j in range(3)]
    tried, write = {}, substrings.materialize

    def watched(df, name):
        out = write(df, name)
        if name.endswith("-pairs"):
            tried[name] = {(r["a"], r["b"]) for r in out.select("a", "b").collect()}
        return out

    monkeypatch.setattr(substrings, "materialize", watched)
    got = {}
    for r in repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect():
        got.setdefault(r["class_id"].split(":")[0], set()).add(r["doc_id"])
    assert got == {str(200 + 10 * k): {200 + 10 * k + j for j in range(3)} for k in range(4)}
    assert sum(map(len, tried.values())) < 100  # 60 * 59 / 2 pairs share the line


def test_passages_in_rounds(spark, monkeypatch):
    """A text is sent once to every part that has a pair of it, and pairs verified in rounds, whose tables are dropped, give the same rows."""
    import os

    from tessera.llm import substrings
    met = "array(struct(1 as hash, array(0) as xs, array(struct(0 as c, 0 as l, 50 as r)) as ys))"
    pairs = spark.range(30).crossJoin(spark.range(100, 130).toDF("b")).selectExpr("id as a", "b", f"{met} as met")
    texts = spark.createDataFrame([(i, b"text") for i in [*range(30), *range(100, 130)]], "doc_id long, packed binary")
    rows = substrings._to_verify(pairs, texts, 4).collect()
    assert len(rows) <= 30 + 30 * 4  # 900 pairs
    assert sorted((p["a"], r["doc"]) for r in rows for p in r["pairs"] or []) == [(a, b) for a in range(30) for b in range(100, 130)]

    text = []
    for k in range(3):
        copy = some_words(140, 9100 + k, 10**7)
        text += [(10 * k + j, " ".join([*copy[:12 * j], *some_words(14, 9200 + 10 * k + j, 10**7), *copy[12 * j + 14:]])) for j in range(9)]
    docs = spark.createDataFrame(text, "doc_id long, text string")
    want = sorted(map(tuple, repeated_passages(docs).collect()))
    folders, write = [], substrings.materialize

    def watched(df, name):
        out = write(df, name)
        folders.extend(f.removeprefix("file:").replace("///", "/") for f in out.inputFiles() if name == "rest-pairs")
        return out

    monkeypatch.setattr(substrings, "materialize", watched)
    monkeypatch.setattr(substrings, "_rounds", lambda held: 3)
    assert sorted(map(tuple, repeated_passages(docs).collect())) == want
    assert len({os.path.dirname(f) for f in folders}) == 3
    assert not any(map(os.path.exists, folders))


def test_passages_of_repeated_lines(monkeypatch):
    """Texts that repeat a line differing in one word meet at every pair of repetitions; few are counted, and none that is similar is lost."""
    from tessera.llm import substrings
    line, calls, earlier = np.arange(1, 32, dtype=np.uint64), [], substrings._earlier
    x, y = np.tile(line, 30), np.tile(np.concatenate([line[:26], line[26:] + np.uint64(100)]), 30)
    meets = [(int(c), np.flatnonzero(y == x[c])) for c in np.flatnonzero(x == 7)]
    monkeypatch.setattr(substrings, "_earlier", lambda v: calls.append(1) or earlier(v))
    assert common_passages(x, y, meets, 46, 0.8) == []
    assert len(calls) < 20
    monkeypatch.undo()
    rng = np.random.default_rng(5)
    for _ in range(150):
        lines = [rng.integers(1, 400, rng.integers(8, 60), dtype=np.uint64) for _ in range(3)]
        x = np.concatenate([lines[k] for k in rng.integers(0, 3, 12)])
        y = np.where(rng.random(len(x)) < rng.choice([0.02, 0.1, 0.3]), rng.integers(1, 400, len(x), dtype=np.uint64), x)
        if rng.random() < 0.5:
            y = np.concatenate([lines[0], y])
        meets = [(int(c), np.flatnonzero(y == x[c])) for c in rng.choice(len(x), 15, replace=False)]
        found = common_passages(x, y, meets, 46, 0.8)
        with monkeypatch.context() as m:
            m.setattr(substrings._Around, "may", lambda self, cx, cy: True)
            m.setattr(substrings._Around, "reach", lambda self, a, c, least, most: most)
            m.setattr(substrings, "CHAIN_PLACES", 0)
            assert common_passages(x, y, meets, 46, 0.8) == found


def test_meetings_come_in_order_and_once():
    """However the rows of a pair's meetings come in, the same meetings are tried in the same order."""
    from tessera.llm.substrings import _untried
    meets = [(5, np.array([9, 2])), (5, np.array([4, 2])), (3, np.array([7])), (5, np.array([4]))]
    assert list(_untried(meets, [])) == list(_untried(meets[::-1], [])) == [(3, 7), (5, 2), (5, 4), (5, 9)]


def test_similar_stretches_keep_every_passage():
    """No stretch of a text whose set is similar to one of another's is left out, with few distinct tokens and runs of one too."""
    from tessera.llm.substrings import _again, _shares, similar_stretches
    r = random.Random(5)
    for _ in range(20):
        x, y = ([w for _ in range(r.randrange(1, 9)) for w in [r.randrange(6)] * r.randrange(1, 6)] for _ in range(2))
        u, held = np.array(x, dtype=np.uint64), np.isin(x, y)
        starts, stops = similar_stretches(np.append(_shares(u, _again(u), held), 0), np.append(_again(u), False), np.array([len(u)]), 5, 0.8)
        inside = np.zeros(len(x), dtype=bool)
        for a, b in zip(starts, stops, strict=True):
            inside[a:b] = True
        sets = {frozenset(y[c:d]) for c in range(len(y)) for d in range(c + 5, len(y) + 1)}
        for a in range(len(x)):
            for b in range(a + 5, len(x) + 1):
                s = set(x[a:b])
                if any(len(s & q) >= 0.8 * len(s | q) for q in sets):
                    assert inside[a:b].all()
