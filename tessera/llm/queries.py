"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK_RE = r"[^\x20\x09-\x0D]+"
ALNUM_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks, leak_digest
    return leak_digest(find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)).drop("n_near")


ORACLE["op9_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_RE}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_RE}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_components
    return similar_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


ORACLE["op8_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BLANK_RE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) c USING (doc_id)
"""


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan, secret_digest
    return secret_digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import detect, license_digest
    return license_digest(detect(table(spark, sf_dir, "documents")))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import crc_rest, score_texts
    labels = table(spark, sf_dir, "labels").filter(crc_rest("doc_id", 4) != 2)
    scored = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, sample_rows=20_000, cut=0.3)
    return scored.select("doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip
    return archive_round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CAST(CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN m END AS BIGINT) AS refers_to
FROM g
"""


@query
def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts
    from .toxicity import crc_rest
    return score_texts(table(spark, sf_dir, "documents"), train=crc_rest("doc_id", 7) != 2)


@query
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents"), words=50, similarity=0.8)


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


ORACLE["op12_ranked_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_RE}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_RE}') AS w FROM benchmark),
i AS (SELECT q, t, count(*) AS k FROM (SELECT q, unnest(w) AS t FROM b) GROUP BY q, t),
a AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
v AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, a GROUP BY t, docs),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * docs) // total AS m FROM d, a WHERE len(w) > 0),
s AS (SELECT i.q, f.r, CAST(sum(i.k * v.weight * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
      FROM f JOIN v USING (t) JOIN m USING (r) JOIN i USING (t) GROUP BY i.q, f.r),
o AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN b USING (q) WHERE rank <= 10
"""


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants
    return variants(table(spark, sf_dir, "documents"))
