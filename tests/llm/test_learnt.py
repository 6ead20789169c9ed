"""Toxicity, language model, quality rules and mixing against brute force, held-out accuracy and edge cases."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm, mixing, quality, toxicity

from .common import SF, blank_words, rest, some_words

HARM = ("moron", "vilest", "scumbag")


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(400):
        w = some_words(40, i, 3000)
        if i % 5 == 0:
            w[7], w[21] = HARM[i % 3], HARM[(i // 5) % 3]
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    rows += [(1000 + i, rows[5][1], 1) for i in range(60)]  # copies of one harmful text
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity_words_and_obfuscation(spark, labelled):
    docs, labels = labelled
    kept, base = toxicity.fit_words(docs, labels)
    assert {f.rstrip("~") for f in kept} and all(any(h.startswith(f.rstrip("~")) for h in HARM) for f in kept) and base < 0.05
    counts = toxicity.char_counts(docs)
    s = toxicity.Scorer(kept, base, counts)
    for text in ("you M0R0N here", "such a m o r o n really", "v1l3st of all", "a s.c.u.m.b.a.g of", "moooooron", "MORON!", "scumb@g", "m*o*r*o*n"):
        assert s.text(text) >= 0.3, text
    for text in (None, "", "w1 w2 w3", "a a a a a a", "call 555-1234 at 10:30", "w12 more on w7 " * 3000, "moral on", "x" * 5000):
        assert s.text(text) < 0.3, (text or "")[:20]


def test_toxicity_dense_obfuscation(spark, labelled):
    docs, labels = labelled
    kept, base = toxicity.fit_words(docs, labels)
    s = toxicity.Scorer(kept, base, toxicity.char_counts(docs))
    dense = ("v1l35t", "v!1e$t", "5cum8@9", "$(um64g", "m-o-r-o-n", "m-0-r-0-n", "m--o--r--o--n", "m..o..r..o..n", "mmoorroonn", "vviilleesstt", "$.c.u.m.b.@.g", "m_0_r_0_n!", "m00rr00nn", "v||3st")
    for word in dense:
        assert s.text(f"such a {word} here") >= 0.3, word
    for text in ("hello letter coffee well-known it's 1st 2nd b2b", "moral-on 12-30 a1 v1 r2d2", "a!b", "mm.oo", "call me at 0800-1234 or x1"):
        assert s.text(text) < 0.3, text
    long = "w1-l0" * 2000
    assert s.text(long) < 0.3


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF[:-5]}0.1/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.1/labels.parquet")
    out = toxicity.score_texts(docs.select("doc_id", "text"), labels.filter(toxicity.crc_rest("doc_id", 4) != 2))
    held = out.join(labels.filter(toxicity.crc_rest("doc_id", 4) == 2), "doc_id").select("toxic", "predicted", "score").toPandas()
    right = held[held.toxic == 1].predicted.mean()
    wrong = held[held.toxic == 0].predicted.mean()
    assert right > 0.75 and wrong < 0.02, (right, wrong)


def test_toxicity_edges(spark, labelled):
    docs, labels = labelled
    rows = [(1, None, "s", 1), (2, "", "s", 1), (None, "a moron", "s", 1), (3, "a moron", "s", 1), (3, "a moron", "s", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int").unionByName(docs.withColumns({"score": F.lit("s"), "predicted": F.lit(1)}))
    got = {(r["doc_id"], r["text"]): (r["score"], r["predicted"]) for r in toxicity.score_texts(odd, labels).filter("doc_id is null or doc_id < 4").collect()}
    assert got[1, None] == got[2, ""] and got[None, "a moron"] == got[3, "a moron"] and got[3, "a moron"][1] == 1
    assert toxicity.score_texts(odd, labels.limit(0)).filter("score > 0").count() == 0
    assert toxicity.score_texts(docs.limit(0), labels).count() == 0


def test_crc(spark):
    got = spark.range(50).select("id", toxicity.crc_rest("id", 7).alias("r")).collect()
    assert all(r["r"] == rest(r["id"], 7) for r in got)


def brute_lm(docs, prior=5.0):
    uni, bi, hist = Counter(), Counter(), Counter()
    for i, t in docs:
        if i is not None and rest(i, 7) != 2:
            w = ["</s>", *blank_words(t), "</s>"]
            uni.update(w[1:])
            bi.update(zip(w, w[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in docs:
        w = ["</s>", *blank_words(t), "</s>"]
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w[1:])
        score = 0.0
        for h, x in zip(w, w[1:], strict=False):
            b = uni[h] / (uni[h] + prior)
            score += math.log10((b * bi[h, x] / uni[h] if uni[h] else 0) + (1 - b) * (uni[x] + 1) / (n + v + 1))
        out.append((i, i is None or rest(i, 7) == 2, len(w) - 1, sum(uni[x] > 0 for x in w[1:]), n, base, score))
    assert hist == Counter()
    return out


def test_lm_brute_force(spark):
    docs = [(i, " ".join(some_words(5 + 3 * i, i, 50))) for i in range(40)] + [(100, None), (101, ""), (None, "w1 w2"), (7, "W1 w2 É"), (7, "W1 w2 É"), (102, " ".join(some_words(30_000, 9)))]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, chunk int, words string").repartition(3)
    got = lm.score_texts(df, train=toxicity.crc_rest("doc_id", 7) != 2, chunk_bytes=2000).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = brute_lm(docs)
    order = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(empty, train=F.lit(True)).count() == 0
    only = lm.score_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), train=F.lit(False)).collect()
    assert only[0]["train_tokens"] == 0 and only[0]["base_score"] == 0.0


def test_lm_packing():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (lm.unpack_sorted(lm.pack_sorted(keys)) == keys).all()


def test_lm_model_sums_to_one(spark):
    model = brute_lm([(1, "a b a c"), (3, "b a")])
    assert model
    words = ["a", "b", "c", "</s>"]
    uni, bi = Counter(a=3, b=2, c=1), Counter({("a", "b"): 1, ("a", "c"): 1, ("b", "a"): 2, ("c", "</s>"): 1, ("</s>", "a"): 1, ("</s>", "b"): 1, ("a", "</s>"): 1})
    uni["</s>"] = 2
    n, v = sum(uni.values()), len(uni)
    for h in words:
        b = uni[h] / (uni[h] + 5)
        known = sum(b * bi[h, w] / uni[h] + (1 - b) * (uni[w] + 1) / (n + v + 1) for w in words)
        assert known + (1 - b) / (n + v + 1) == pytest.approx(1)  # with the one unknown word


def brute_quality(text):
    text = text or ""
    words = blank_words(text, fold=False)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if blank_words(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i:i + 5]), []).append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n


EDGE = [(900, None, None, None), (901, "", "en", "s"), (902, "\n\n \n", "en", None), (903, "é😀 a\na b\na b\n a b\n", None, "s"), (904, "a b c d e " * 2000, "en", "s"), (904, "a b c d e " * 2000, "en", "s"),
        (905, "x y z a b c d e f g h i j k x y z a b", "en", "s"), (None, "one two three four five six seven eight nine ten", "en", "s"), (906, "aaaa### " * 60, "en", "s")]


def test_quality_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionByName(spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")).withColumn("kept", F.lit("x")).withColumn("signs", F.lit(1))
    rows = quality.judge(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        want = brute_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, r["doc_id"]
        assert not (r["kept"] and r["base_failed"])
    by = {r["doc_id"]: r for r in rows}
    assert by[906]["failed"] == ["signs"] or by[906]["base_failed"]
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_keeps_good_rows(spark):
    docs, labels = spark.read.parquet(f"{SF[:-5]}0.1/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.1/labels.parquet")
    rows = quality.judge(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.002 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_quality_small_groups_use_larger_ones(spark):
    rows = [(i, " ".join(some_words(50, i)), "en", f"s{i % 3}") for i in range(90)] + [(500, "#a b# " * 30 + " ".join(some_words(200, 3)), "xx", "rare")]
    got = {r["doc_id"]: r["failed"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), group_rows=50).collect()}
    # a third of its words repeat, which no text of the larger groups shows
    assert got[500] == ["signs", "repeats"] and not any(got[i] for i in range(90))


def exact_fence(values, step, up, width=2.0):
    """The fence of a group from its sorted values: quantile q is the smallest value with a share of q at or below it."""
    values, sign = sorted(values), 1 if up else -1
    at = lambda q: values[max(0, math.ceil(round(q * len(values), 6)) - 1)]
    mid = at(0.5)
    fence = mid + sign * width * step
    for q in quality.LADDER:
        rung = at(q if up else 1 - q)
        if sign * (rung - fence) > 0:
            break
        fence = rung + sign * width * max(sign * (rung - mid), step)
    return fence


def signals_of(spark, docs):
    rows = [r.asDict() for r in quality.measure(docs).collect()]
    rows = [r for r in rows if r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]]
    value = {"mean_word": lambda r: r["word_chars"] / r["n_words"], "signs": lambda r: r["n_symbols"] / r["n_words"],
             "dup_lines": lambda r: r["n_dup_lines"] / max(r["n_lines"], 1), "repeats": lambda r: r["n_repeat_words"] / r["n_words"]}
    return [(r["lang"], r["source"], *[f(r) for f in value.values()]) for r in rows], list(value)


def test_quality_fences_brute_force(spark):
    """Fences equal those of exact quantiles for groups, languages and the corpus (sketches of so few rows are exact)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), "source")
    rows, names = signals_of(spark, docs)
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{s} double" for s in names))
    sources = {r[:2] for r in rows}
    for group_rows in (5, 40, 10**9):
        got = {(r["f_lang"], r["f_source"]): r for r in quality.fences(df, group_rows, 2.0).collect()}
        assert set(got) == sources
        for (lang, source), r in got.items():
            own = [x for x in rows if x[:2] == (lang, source)]
            if len(own) < group_rows:
                own = [x for x in rows if x[0] == lang]
            if len(own) < group_rows:
                own = rows
            for i, s in enumerate(names):
                assert r[f"{s}_high"] == pytest.approx(exact_fence([x[2 + i] for x in own], quality.SIGNALS[s][1], True)), (group_rows, lang, source, s)
            assert r["mean_word_low"] == pytest.approx(exact_fence([x[2] for x in own], quality.SIGNALS["mean_word"][1], False))


def test_quality_sketch_ranks(spark):
    """Quantiles of a large group, merged from many partitions, stay within one rank in a hundred."""
    n = 60_000
    df = spark.range(n).repartition(16).select(F.col("id").cast("double").alias("x"))
    at = [0.5, *quality.LADDER]
    sketch = df.groupBy((F.col("x") % 9).alias("g")).agg(F.kll_sketch_agg_double("x", F.lit(quality.SKETCH_K)).alias("x"))
    got = sketch.agg(F.kll_merge_agg_double("x", F.lit(quality.SKETCH_K)).alias("x")).select(F.kll_sketch_get_quantile_double("x", F.array(*map(F.lit, at)))).first()[0]
    assert all(abs(v / n - q) <= 0.01 for v, q in zip(got, at, strict=True))


def test_quality_adapts(spark):
    """Each signal rejects rows that the base rule keeps, and a habit of one source is kept there and rejected in another."""
    r = random.Random(3)
    line = lambda: " ".join(f"word{r.randrange(10**6)}" for _ in range(12))

    def text(signs=0, dup=0, repeat=0, long=False):
        lines = [line() for _ in range(20)]
        if repeat:  # a line's words come again within a longer line
            lines[10] = "x " + lines[0]
        if long:
            lines = [x.replace("word", "w" * 14) for x in lines]
        lines = [y for i, x in enumerate(lines) for y in ([x, "word777777"] if i <= dup > 0 else [x])]
        return "\n".join(lines) + "".join(f" #sign{i + 10000}" for i in range(signs))

    rows = [(i, text(), "en", "plain") for i in range(300)]
    rows += [(1000 + i, text(signs=5 + i % 60, dup=i % 15), "en", "code") for i in range(300)]
    cases = {"signs": text(signs=60), "dup_lines": text(dup=14), "repeats": text(repeat=1), "mean_word": text(long=True)}
    rows += [(5000 + i, t, "en", "plain") for i, t in enumerate(cases.values())]
    rows += [(6000 + i, t, "en", "code") for i, t in enumerate(cases.values())]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for i, s in enumerate(cases):
        assert got[5000 + i]["failed"] == [s] and not got[5000 + i]["base_failed"] and not got[5000 + i]["kept"]
    assert got[6000]["kept"] and got[6001]["kept"]
    assert all(got[i]["kept"] and got[1000 + i]["kept"] for i in range(300))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF[:-5]}0.1/documents.parquet").select("doc_id", "text", "source")
    extra = [(90_000 + i, " ".join(some_words(5 + i % 50, i)), None) for i in range(300)] + [(95_000, None, "src1"), (95_001, "", "zz"), (95_002, "w", "é"), (95_002, "w", "é"), (None, "w w", "src2")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string")).withColumns({"size": F.lit(1), "rank": F.lit("x"), "s": F.lit(2)})
    rows = mixing.mix(docs, carry=["rank"]).collect()
    assert len(rows) == docs.count() and all(r["rank"] == "x" for r in rows)
    texts = Counter()
    for r in docs.collect():
        texts[r["source"]] += len(blank_words(r["text"]))
    want, taken = targets(dict(texts)), Counter()
    for r in rows:
        assert r["source_size"] == texts[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 60), (s, taken[s], t)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "source", "copies").collect()
    assert Counter((r["doc_id"], r["source"], r["copies"]) for r in rows) == Counter((r[0], r[1], r[2]) for r in again)


def test_mixing_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2
