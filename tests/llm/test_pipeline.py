"""The pipeline's stages against plain Python, each on its own input, and on edge cases."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from .common import SF, alnum_words, blank_words, some_words
from .test_native import base_spans
from .test_similar import brute_components, brute_leaks


@pytest.fixture(scope="module")
def run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "same text of ten words stands here twice for once", "en", "s", 1), (None, "same text of ten words stands here twice for once", "en", "s", 1),
           (9000, "", "en", "src0", 0), (9001, "a token=abcdefgh1234 b", "en", "src0", 1), (9002, "w " * 40_000, "en", None, 5), (9002, "another text under one id", "en", "s", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    steps = [docs]
    for _, stage in P.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
        steps[-1].count()
    yield steps
    for s in steps:
        s.unpersist()


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()), key=str)


def test_columns(run):
    for df in run[:-1]:
        assert df.columns == run[0].columns


def test_toxicity_stage(spark, run):
    before, after = rows(run[0]), rows(run[1])
    assert set(map(str, after)) <= set(map(str, before)) and 0.8 * len(before) < len(after) <= len(before)


def test_near_duplicate_stage(run):
    before, after = rows(run[1]), rows(run[2])
    _, comp = brute_components([(i, r[1]) for i, r in enumerate(before)], 5, 8, 10)
    assert len(after) == len(set(comp.values()))
    group = {}
    for i, r in enumerate(before):
        group.setdefault(str(r), set()).add(comp[i])
    left = [min(group[str(r)]) for r in after]
    assert len(set(left)) + sum(not blank_words(r[1]) for r in after) >= len(after)


def test_near_duplicate_stage_threshold(spark):
    """A copy with a fifth of new text (similarity 0.827 in runs of five words) goes, one with a third (0.744) stays."""
    base, other = some_words(100, 1, 10**6), some_words(100, 2, 10**6)
    texts = [(1, base), (2, base + some_words(20, 3, 10**7)), (3, other), (4, other + some_words(33, 4, 10**7))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, SF).collect()} == {1, 3, 4}


def test_leak_stage(spark, run):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute_leaks([(i, r[1]) for i, r in enumerate(rows(run[2]))], bench)
    assert rows(run[3]) == [r for r, f in zip(rows(run[2]), found, strict=True) if not f[5]]
    assert alnum_words("A b") == ["a", "b"]


def test_secret_stage(run):
    before, after = run[3].collect(), run[4].collect()
    assert len(before) == len(after)
    assert not any(base_spans(r["text"]) for r in after)
    clean = sorted(str(tuple(r)) for r in before if not base_spans(r["text"]))
    kept = {str(tuple(r)) for r in after}
    assert sum(r in kept for r in clean) >= 0.99 * len(clean)


def test_mixture_stage(run):
    out = run[5]
    assert {*run[0].columns, "copies", "taken", "target"} <= set(out.columns)
    assert out.filter("copies < 1 or copies > 2 or taken <> size * copies").count() == 0
    got = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    docs = {r["source"]: r["sizes"] for r in run[4].groupBy("source").agg(F.collect_list(F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""))).alias("sizes")).collect()}
    for r in got:
        if len(docs[r["source"]]) == 1:  # a lone document can only give whole copies of itself: the number nearest to the target
            n = docs[r["source"]][0]
            assert abs(r["t"] - r["target"]) == min(abs(k * n - r["target"]) for k in (0, 1, 2))
        else:
            assert abs(r["t"] - r["target"]) <= max(0.15 * r["target"], 60)


def test_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [s[0] for s in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixture"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_tasks_hold_few_rows_at_a_time(spark):
    """A whole partition in one Arrow batch took an executor over its memory."""
    import pyarrow as pa

    from tessera.session import BATCH_ROWS, ship_package

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.num_rows for b in batches)], type=pa.int64())], names=["n"])

    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 5_000, 1, 1)
    before = spark.conf.get(key)
    try:
        for given, most in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("10", 10)):
            spark.conf.set(key, given)
            ship_package(spark)
            assert rows.mapInArrow(largest, "n long").first()["n"] == most
    finally:
        spark.conf.set(key, before)
