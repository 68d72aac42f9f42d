"""Queries of frame timelines and of array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from timeloom.functions import arrays
from timeloom.operators import cluster, frames

from . import projections as P
from .registry import registry

QUERIES, SQL, query = registry()
TYPES = ("click", "error", "purchase", "signup", "view")
W = "WINDOW w AS (PARTITION BY user_id ORDER BY frame)"


def by_user() -> WindowSpec:
    """Made when a query runs, as windows need a session."""
    return Window.partitionBy("user_id").orderBy("frame")


@query(f"""WITH {P.FRAMES}, m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM frames {W}), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, event_type, CAST(min(frame) AS INTEGER) AS start, count(*) AS length FROM g GROUP BY user_id, event_type, g""")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.runs(P.frames(spark, sf_dir), ["user_id"], "event_type")


@query(f"""WITH {P.FRAMES}, b AS (SELECT *, score > 0.2 AS on FROM frames), m AS (SELECT *, CASE WHEN lag(b.on) OVER w = b.on THEN 0 ELSE 1 END AS fresh FROM b {W}), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, g.on AS voiced, CAST(min(frame) AS INTEGER) AS start, count(*) AS length FROM g GROUP BY user_id, g.on, g HAVING count(*) > 7""")
def min_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of more than seven frames."""
    return frames.long_runs(P.frames(spark, sf_dir).withColumn("voiced", F.col("score") > 0.2), ["user_id"], "voiced", 7)


@query(f"""WITH {P.FRAMES}, n AS (SELECT user_id, frame, event_type, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, list(event_type) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS l FROM frames {W}),
c AS (SELECT user_id, frame, unnest(list_distinct(l)) AS x, l FROM n), r AS (SELECT user_id, frame, x, row_number() OVER (PARTITION BY user_id, frame ORDER BY len(list_filter(l, lambda y: y = x)) DESC, x) AS k FROM c), m AS (SELECT n.*, r.x FROM n JOIN r ON r.user_id = n.user_id AND r.frame = n.frame AND k = 1),
h AS (SELECT user_id, x AS head FROM m WHERE i = 13) SELECT m.user_id, CAST(m.frame AS INTEGER) AS frame, CASE WHEN n <= 25 THEN event_type WHEN i <= 12 THEN head ELSE x END AS smoothed FROM m LEFT JOIN h ON h.user_id = m.user_id""")
def majority_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.majority_filter(P.frames(spark, sf_dir), ["user_id"], "event_type", TYPES, 25).select("user_id", "frame", "smoothed")


@query(f"""WITH {P.FRAMES}, l AS (SELECT user_id, frame, list(score) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS l FROM frames)
SELECT user_id, CAST(frame AS INTEGER) AS frame, round(list_sort(list_concat(l, list_resize(CAST([] AS DOUBLE[]), 13 - len(l), CAST(0 AS DOUBLE))))[7], 6) AS filtered FROM l""")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.frames(spark, sf_dir).select("user_id", "frame", F.round(frames.median_filter(F.col("score"), by_user(), 13), 6).alias("filtered"))


@query(f"""WITH {P.FRAMES}, b AS (SELECT user_id, frame, CAST(score > 0.3 AS INTEGER) AS v FROM frames), d AS (SELECT user_id, frame, max(v) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING) AS d FROM b)
SELECT user_id, CAST(frame AS INTEGER) AS frame, CAST(CASE WHEN count(*) OVER v = 12 AND min(d) OVER v = 1 THEN 1 ELSE 0 END AS INTEGER) AS closed FROM d WINDOW v AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""")
def binary_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.frames(spark, sf_dir).withColumn("voiced", (F.col("score") > 0.3).cast("int"))
    return frames.closing(f, ["user_id"], "voiced", 12).select("user_id", "frame", "closed")


@query(f"WITH {P.FRAMES} SELECT event_type, CAST(frame AS INTEGER) AS frame, user_id, round(score, 6) AS score FROM frames QUALIFY row_number() OVER (PARTITION BY event_type, frame ORDER BY score DESC, user_id) = 1")
def frame_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user with the best score of each event type and frame number."""
    won = frames.winner(P.frames(spark, sf_dir), ["event_type"], "score", "user_id")
    return won.select("event_type", "frame", "user_id", F.round("score", 6).alias("score"))


@query(f"""WITH {P.FRAMES}, k AS (SELECT user_id, frame, CASE WHEN event_id % 3 = 0 THEN score END AS v FROM frames)
SELECT user_id, CAST(frame AS INTEGER) AS frame, round(coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS v FROM k""")
def missing_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 3 == 0, F.col("score"))
    f = P.frames(spark, sf_dir).withColumn("v", v)
    return f.select("user_id", "frame", F.round(frames.fill(F.col("v"), by_user()), 6).alias("v"))


@query(f"""WITH {P.FRAMES}, k AS (SELECT user_id, frame * 3 AS f, score, lead(frame * 3) OVER w AS f2, lead(score) OVER w AS s2 FROM frames {W}), x AS (SELECT *, unnest(range(f, coalesce(f2, f + 1))) AS frame FROM k)
SELECT user_id, CAST(frame AS INTEGER) AS frame, round(coalesce(score + (s2 - score) * (frame - f) / (f2 - f), score), 6) AS score FROM x""")
def bbox_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at every third frame, and straight lines between them."""
    known = P.frames(spark, sf_dir).select("user_id", (F.col("frame") * 3).alias("frame"), "score")
    return frames.interpolate(known, ["user_id"], "score").select("user_id", "frame", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), i AS (SELECT vec_id, v, unnest(range(0, 100)) AS i FROM e), p AS (SELECT *, least(63, greatest(0, (i + 0.5) * 64 / 100 - 0.5)) AS p FROM i)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(v[CAST(floor(p) AS INTEGER) + 1] + (p - floor(p)) * (v[least(63, CAST(floor(p) AS INTEGER) + 1) + 1] - v[CAST(floor(p) AS INTEGER) + 1]), 6) AS x FROM p""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.resample(F.col("embedding").cast("array<double>"), 100)).alias("i", "x"))
    return e.select("vec_id", "i", F.round("x", 6).alias("x"))


@query("SELECT vec_id, list_transform(list_concat(embedding[1:40], list_resize(CAST([] AS FLOAT[]), 30, CAST(0 AS FLOAT)))[1:56], lambda x: round(CAST(x AS DOUBLE), 6)) AS v FROM embeddings")
def cut_or_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 components, padded to 56."""
    v = arrays.cut_or_pad(F.slice("embedding", 1, 40), 56, F.lit(0).cast("float"))
    return P.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(v, lambda x: arrays.rounded(x.cast("double"), 6)).alias("v"))


@query("SELECT doc_id, list_prepend(CAST(1048 AS BIGINT), range(1, 1 + doc_id % 9)) AS inputs, list_append(range(1, 1 + doc_id % 9), CAST(1048 AS BIGINT)) AS targets FROM documents")
def sos_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sequences with a start and with an end, padding removed."""
    n = F.col("doc_id") % 9
    ids = F.concat(F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>")), F.array_repeat(F.lit(-1).cast("bigint"), 3))
    one, two = arrays.add_sos_eos(ids, F.lit(1048).cast("bigint"), F.lit(1048).cast("bigint"), -1)
    return P.table(spark, sf_dir, "documents").select("doc_id", one.alias("inputs"), two.alias("targets"))


@query("""WITH e AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings) SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM e GROUP BY 1, 2""")
def mean_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.mean_by(P.table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumn("x", F.round("x", 6))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4""")
def cosine_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label whose cosine similarity reaches 0.4."""
    pairs = cluster.similar(P.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.4)
    return pairs.withColumn("cosine", F.round("cosine", 6))


@query("""SELECT event_id, round(CASE WHEN step < 100 THEN step / 100.0 * 0.001 ELSE 0.001 * 0.5 * (1 + cos(pi() * (step - 100) / 900.0)) END, 9) AS lr FROM (SELECT event_id, event_id % 1000 AS step FROM events)""")
def warmup_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learning rate by step: linear warm-up, then a cosine to zero."""
    lr = arrays.warmup_cosine(F.col("event_id") % 1000, 100, 1000, 0.001)
    return P.table(spark, sf_dir, "events").select("event_id", F.round(lr, 9).alias("lr"))
