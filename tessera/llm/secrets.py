"""Secret scan: fixed patterns plus character Markov models compared by log-likelihood ratio. DataFrame functions only.

Two first-order character models are fitted on labelled samples: random strings (label 1) and
ordinary identifiers (label 0). A long run of token characters outside the fixed patterns' spans is
reported when the log-likelihood ratio of the two models, summed over its characters, is high enough
in all and for each character. The fitted table has 128 x 128 entries whatever the corpus.

Default samples: random strings are digests written in hexadecimal, base 64 and base 36, and the
values that follow secret names in a bounded sample of documents; ordinary identifiers are the
other token runs of those documents (``sample_docs``, a documented bound: only the model depends on
it; every whole text is scanned).

Defined results: null and empty texts have no spans; spans are in code points, end exclusive, ordered
by start and kind; repeated rows repeat their result; other columns are not read (names that start
with an underscore and ``found`` and ``base`` are the operator's own). Only ASCII
characters take part in token runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import bound, highest_before, let, match_spans

ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
RUN = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
SIDE = 128


def random_samples(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """Strings drawn from a cryptographic digest, in the alphabets keys are written in."""
    d = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    wide = F.regexp_replace(F.base64(F.unhex(F.concat(d, F.sha2(d, 256)))), "[=\\s]", "")
    return spark.range(rows).select(F.explode(F.array(
        F.substring(d, 1, 40), wide, F.translate(wide, "+/", "-_"), F.concat_ws("", F.transform(
            F.sequence(F.lit(0), F.lit(11)), lambda i: F.conv(F.substr(F.concat(d, d), i * 5 + 1, F.lit(5)), 16, 36))))).alias("sample"), F.lit(1).alias("label"))


def corpus_samples(docs: DataFrame, sample_docs: int) -> DataFrame:
    """Labelled runs of a bounded sample of documents: values after secret names (1), other token runs (0)."""
    rows = docs.count()
    part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(1, rows))))
    values = part.select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("sample")).filter("length(sample) >= 16")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = part.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_-]{8,}"), F.lit(0))).alias("sample"))
    return values.select("sample", F.lit(1).alias("label")).unionByName(words.select("sample", F.lit(0).alias("label")))


def fit(samples: DataFrame, smoothing: float = 4.0) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of a character after another, as a flat 128 x 128 table.

    Row 0 is the start of a string. ``samples`` has sample and label; characters beyond ASCII count as 0.
    """
    code = lambda c: F.when(F.ascii(c) < SIDE, F.ascii(c)).otherwise(0)
    pairs = samples.filter("length(sample) > 0").select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("sample")), lambda i: F.struct(
        F.when(i > 1, code(F.substr("sample", F.greatest(i - 1, F.lit(1)), F.lit(1)))).otherwise(0).alias("p"), code(F.substr("sample", i, F.lit(1))).alias("c")))).alias("x"))
    counts = pairs.groupBy("label", "x.p", "x.c").count().collect()  # at most 2 x 128 x 128 rows
    n = [[0.0] * (SIDE * SIDE) for _ in range(2)]
    for r in counts:
        n[1 if r["label"] else 0][r["p"] * SIDE + r["c"]] += r["count"]
    # a pair's estimate leans on how often its second character stands anywhere
    alone = [[sum(k[c::SIDE]) for c in range(SIDE)] for k in n]
    alone = [[(x + 0.5) / (sum(k) + 0.5 * SIDE) for x in k] for k in alone]
    llr = [0.0] * (SIDE * SIDE)
    for p in range(SIDE):
        row = [sum(k[p * SIDE:(p + 1) * SIDE]) for k in n]
        for c in range(SIDE):
            i = p * SIDE + c
            ordinary, random = (math.log((n[j][i] + smoothing * alone[j][c]) / (row[j] + smoothing)) for j in (0, 1))
            llr[i] = random - ordinary
    return llr


def _ratio(run: Column, table: Column) -> Column:
    start = F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.length(run)), start, lambda a, i: let(F.ascii(F.substr(run, i, F.lit(1))), lambda c: F.struct(
        c.alias("p"), (a["s"] + F.element_at(table, a["p"] * SIDE + c + 1)).alias("s"))), lambda a: a["s"])


def scan(docs: DataFrame, samples: DataFrame | None = None, sample_docs: int = 2000, least: float = 14.0, least_each: float = 0.55) -> DataFrame:
    """``docs`` with ``found``: array<struct<start, kind_no, end>> of all spans, and ``base``: those of the fixed patterns.

    ``docs`` needs doc_id and text; its other columns are kept (``found`` and ``base`` are replaced).
    """
    spark = docs.sparkSession
    docs = docs.drop("found", "base")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if samples is None:
        own = docs.select("doc_id", text.alias("text"))
        samples = random_samples(spark).unionByName(corpus_samples(own, sample_docs))
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in fit(samples))), ",").cast("array<double>")

    span = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind_no"), m["end"].alias("end"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    low = F.lower("_t")
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    value = lambda m: F.regexp_extract(m["match"], ASSIGN, 2)
    assign = F.when(named, F.filter(match_spans(F.col("_t"), ASSIGN), lambda m: F.length(value(m)) >= 8)).otherwise(empty)
    access = F.when(F.col("_t").contains("AKIA"), match_spans(F.col("_t"), ACCESS)).otherwise(empty)
    fixed = F.concat(F.transform(assign, span(0)), F.transform(access, span(1)), F.transform(match_spans(F.col("_t"), HEX), span(2)))
    out = bound(docs.withColumn("_t", text), base=F.array_sort(fixed))
    apart = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    likely = lambda m: let(_ratio(m["match"], table), lambda s: (s >= least) & (s >= least_each * F.length(m["match"])))
    extra = F.filter(match_spans(F.col("_t"), RUN), lambda m: apart(m) & likely(m))
    return bound(out, found=F.array_sort(F.concat("base", F.transform(extra, span(3))))).drop("_t")


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def secret_digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("found").alias("spans"))


def redact(docs: DataFrame, mark: str = "[removed]", **options) -> DataFrame:
    """``docs`` with every span of a text replaced by ``mark`` (overlapping spans by one); texts without spans are untouched.

    ``n_chars`` follows the new text where the table has that column. The new text is computed once a
    row, whatever is planned on top of the result (another scan included).
    """
    found = scan(docs, **options).withColumnRenamed("text", "_old")
    pieces = let(highest_before(F.transform("found", lambda s: s["end"])), lambda before: F.transform("found", lambda s, i: F.when(
        s["start"] >= F.get(before, i), F.concat(F.substr("_old", (F.get(before, i) + 1).cast("int"), (s["start"] - F.get(before, i)).cast("int")), F.lit(mark))).otherwise("")))
    tail = F.substr("_old", (F.array_max(F.transform("found", lambda s: s["end"])) + 1).cast("int"), F.length("_old"))
    clean = bound(found, text=F.when(F.size("found") > 0, F.concat(F.concat_ws("", pieces), tail)).otherwise(F.col("_old")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)
