"""Registered queries of the corpus operators: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_in_middle, fingerprints, kneser_ney, language_id, license_scan, line_dedup, ngram_join, packing, periodic_runs, topk, url_filter, warc

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH s AS (SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS w FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS line FROM s),
u AS (SELECT line, min(struct_pack(d := doc_id, i := i)) AS p, length(line) AS n FROM l WHERE trim(line, E' 	
') <> '' GROUP BY line),
g AS (SELECT line, p, n, n + e AS m, left(line, (n + e) // 2) AS half, 0 AS side FROM u, (VALUES (0), (1)) v(e)
  UNION ALL SELECT line, p, n, n + e, right(line, n + e - (n + e) // 2), 1 FROM u, (VALUES (0), (1)) v(e)),
c AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n AS an, b.n AS bn, b.p FROM g a JOIN g b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.line <> b.line AND abs(a.n - b.n) <= 1),
k AS (SELECT a AS line, min(p) AS p FROM c WHERE len(list_filter(range(0, greatest(an, bn)), lambda q: left(a, q) = left(b, q)
  AND substr(a, q + 1 + CASE WHEN an >= bn THEN 1 ELSE 0 END) = substr(b, q + 1 + CASE WHEN bn >= an THEN 1 ELSE 0 END))) > 0 GROUP BY a),
f AS (SELECT l.*, u.line IS NULL OR (u.p = struct_pack(d := l.doc_id, i := l.i) AND (k.p IS NULL OR k.p > struct_pack(d := l.doc_id, i := l.i))) AS stays
  FROM l LEFT JOIN u ON u.line = l.line LEFT JOIN k ON k.line = l.line)
SELECT s.doc_id, count(f.i) AS n_lines, count(f.i) FILTER (f.stays) AS n_kept,
  coalesce(string_agg(f.line, chr(10) ORDER BY f.i) FILTER (f.stays), '') AS text
FROM s LEFT JOIN f ON f.doc_id = s.doc_id GROUP BY s.doc_id
"""


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "language", "confidence", "accepted")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


TEMPLATE_ROWS = ", ".join(
    f"('{label}', {license_scan.width_of(len(words))}, list_distinct(string_split('{' '.join(words)}', ' ')), list_filter(string_split('{' '.join(sorted(set(words) & set(license_scan.TELLING)))}', ' '), lambda w: w <> ''))"
    for label, words in ((label, license_scan.words_of(text)) for label, text in license_scan.TEMPLATES)
)
PHRASE_ROWS = ", ".join(f"('{label}', ' {text} ')" for label, text in license_scan.PHRASES)
OP6_SQL = rf"""
WITH t(label, width, words, needs) AS (VALUES {TEMPLATE_ROWS}), p(label, phrase) AS (VALUES {PHRASE_ROWS}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n_words, label, unnest(list_filter(range(0, len(w)),
  lambda i: array_to_string(w[i + 1:i + len(string_split(trim(phrase), ' '))], ' ') = trim(phrase))) AS i
  FROM d, p WHERE contains(' ' || array_to_string(w, ' ') || ' ', phrase)),
b AS (SELECT doc_id, width, unnest(list_transform(range(0, (len(w) + h - 1) // h), lambda i: list_distinct(w[h * i + 1:h * i + width]))) AS w
  FROM d, (SELECT DISTINCT width, width // 2 AS h FROM t)),
m AS (SELECT doc_id, label, max(len(list_intersect(b.w, t.words)) / len(t.words)) AS c FROM b, t
  WHERE b.width = t.width AND len(list_intersect(b.w, t.words)) * 1000000 >= len(t.words) * 800000 AND len(list_intersect(b.w, t.needs)) = len(t.needs) GROUP BY ALL),
x AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM s GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM s UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
z AS (SELECT doc_id, max(c) AS c FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(z.c, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = r"""
WITH r(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, row_number() OVER () AS n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT c.n, arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule,
  arg_max(r.action, length(r.host || r.path) * 1000 + length(r.host)) AS action
  FROM c JOIN r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY c.n)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM c LEFT JOIN m ON c.n = m.n
"""


def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from nine tenths of the documents by their ids; pairs of words, as longer n-grams outgrow the disk (README)."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = kneser_ney.fit(rows.where("not held_out"), order=2)
    found = kneser_ney.score(rows, model, carry=("held_out",))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")


def tailed(doc_id: Column, text: Column) -> Column:
    """Of one document in ten, by id, the words with a periodic tail; other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def looped(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + F.abs(i - a) % p + 1).cast("int")))), " ")

    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, looped(w)).otherwise("")), 1)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tailed(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text"))
    found = periodic_runs.runs_of(docs)
    best = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.signum(a["period"] - b["period"]).cast("int")))
    found = found.withColumn("top", F.get(best, F.lit(0)))
    numbers = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))  # noqa: E731
    lines = F.array_join(F.transform("runs", lambda r: F.concat(numbers(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")), F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )  # fmt: skip


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_bpe_round_trip, op3_language_id, op4_fingerprints, op5_warc, op6_license_scan, op7_packing, op8_ngram_join, op9_top_k, op10_url_filter,
        op11_kneser_ney, op12_periodic_runs, op13_fill_in_middle,
    )
}  # fmt: skip
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op6_license_scan": OP6_SQL, "op8_ngram_join": OP8_SQL, "op9_top_k": OP9_SQL, "op10_url_filter": OP10_SQL}
