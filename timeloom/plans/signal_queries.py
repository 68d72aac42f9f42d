"""Queries of sync distances, label statistics and smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions import masks
from timeloom.operators import signals

from . import projections as P
from .registry import registry

QUERIES, SQL, query = registry()


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as distances of 21 shifts: twenty frames a track."""
    e = P.table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 20).alias("track"), (F.col("vec_id") % 20).alias("frame"), F.transform(F.slice("embedding", 1, 21), lambda x: F.abs(x.cast("double"))).alias("d"))


DISTANCES = "d AS (SELECT vec_id // 20 AS track, vec_id % 20 AS frame, list_transform(embedding[1:21], lambda x: abs(CAST(x AS DOUBLE))) AS d FROM embeddings)"
SHIFTS = f"{DISTANCES}, u AS (SELECT track, unnest(range(0, 21)) AS shift, unnest(d) AS x FROM d), m AS (SELECT track, shift, avg(x) AS x FROM u GROUP BY 1, 2), b AS (SELECT track, arg_min(shift, x) AS shift, median(x) AS middle FROM m GROUP BY 1)"


@query(f"WITH {SHIFTS} SELECT track, CAST(shift AS INTEGER) AS shift, round(middle, 6) AS middle FROM b")
def sync_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.best_shift(distances(spark, sf_dir), ["track"], "d").withColumn("middle", F.round("middle", 6))


@query(f"WITH {SHIFTS} SELECT d.track, frame, round(middle - d.d[shift + 1], 6) AS confidence FROM d JOIN b ON b.track = d.track")
def sync_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.sync_confidence(distances(spark, sf_dir), ["track"], "d").withColumn("confidence", F.round("confidence", 6))


@query("""WITH c AS (SELECT doc_id % 7 + 1 AS id, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT unnest(range(0, 20)) AS id), f AS (SELECT e.id, CASE WHEN e.id = 0 THEN 0 ELSE greatest(1, coalesce(n, 1)) END AS n FROM e LEFT JOIN c ON c.id = e.id)
SELECT CAST(id AS INTEGER) AS id, round(n / sum(n) OVER (), 9) AS share FROM f""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_repeat((F.col("doc_id") % 7 + 1).cast("int"), 2).alias("ids")
    return signals.label_distribution(P.table(spark, sf_dir, "documents").select(ids), "ids", 20).withColumn("share", F.round("share", 9))


@query(f"""WITH {P.FRAMES}, n AS (SELECT user_id, frame, score, list(score) OVER (PARTITION BY user_id ORDER BY frame) AS l, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, list(score) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
r AS (SELECT *, least(6, i - 1, n - i) AS r FROM n) SELECT user_id, CAST(frame AS INTEGER) AS frame, round(list_avg(a[i - r:i + r]), 6) AS smoothed FROM r""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.moving_average(P.frames(spark, sf_dir), ["user_id"], "score", 6)
    return out.select("user_id", "frame", F.round("smoothed", 6).alias("smoothed"))


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id % 16 AS batch, count(*) AS sequences, CAST(sum(n) AS BIGINT) AS frames, TRUE AS equal_counts, TRUE AS padding_open, TRUE AS some_open, TRUE AS full_width FROM u GROUP BY 1""")
def span_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span masks of a sequence a user, in batches: all of a batch mask as many frames, none of the padding and never all."""
    u = P.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("size")).withColumns({"batch": F.col("user_id") % 16, "width": F.col("size") + F.col("user_id") % 9})
    spans = masks.Spans(0.4, 8, "uniform", other=2, least=1, overlap=False, space=3, equal="trim")
    m = masks.batch_masks(u, "user_id", "size", spans, "batch", "width", seed=7)
    count = F.size(F.filter("mask", lambda x: x))
    return m.groupBy("batch").agg(
        F.count("*").alias("sequences"), F.sum("size").alias("frames"), (F.min(count) == F.max(count)).alias("equal_counts"), F.bool_and(~F.exists(F.slice("mask", F.col("size").cast("int") + 1, (F.col("width") - F.col("size")).cast("int")), lambda x: x)).alias("padding_open"),
        F.bool_and((count < F.col("size")) & ((count > 0) | (F.col("size") < 2))).alias("some_open"), F.bool_and(F.size("mask") == F.col("width")).alias("full_width"),
    )
