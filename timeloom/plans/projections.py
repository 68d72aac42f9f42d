"""The driver's tables seen as timeline relations, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds and their day."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({"t": F.unix_micros(F.col("ts").cast("timestamp")), "clip": F.date_format("ts", "yyyy-MM-dd")})


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments: an event type speaks for ``value`` seconds (rounded) from each of its events on."""
    e = events(spark, sf_dir)
    return e.select("clip", F.col("event_type").alias("speaker"), F.col("t").alias("t0"), (F.col("t") + F.round("value").cast("bigint") * SECOND).alias("t1"), "event_id")


def hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments with some missing, shifted, resized or given to another speaker."""
    r = reference(spark, sf_dir).where("event_id % 11 <> 0")
    name = F.when(F.col("event_id") % 13 == 0, "x_error").otherwise(F.concat(F.lit("x_"), "speaker"))
    moved = r.select("clip", name.alias("speaker"), (F.col("t0") + (F.col("event_id") % 7 - 3) * SECOND).alias("t0"), (F.col("t1") + (F.col("event_id") % 5 - 2) * SECOND).alias("t1"), "event_id")
    return moved.where("t1 > t0")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face track for each user and day: from the first to the last event."""
    e = events(spark, sf_dir)
    return e.groupBy("clip", F.col("user_id").alias("track")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event of a user in order, with a score in [0, 1] and a label."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, sf_dir)
    return e.select("user_id", (F.row_number().over(order) - 1).alias("frame"), (F.col("value") / 500).alias("score"), "event_type", "t", "event_id")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as captions: six seconds each, four seconds apart."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn").cast("bigint") * 4 * SECOND
    return c.select(F.col("conv_id").alias("clip"), F.col("turn"), F.col("role").alias("speaker"), start.alias("t0"), (start + 6 * SECOND).alias("t1"), "text")


REFERENCE = "ref AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS clip, event_type AS speaker, epoch_us(ts) AS t0, epoch_us(ts) + CAST(round(value) AS BIGINT) * 1000000 AS t1 FROM events)"
HYPOTHESIS = """hyp AS (SELECT * FROM (SELECT event_id, clip, CASE WHEN event_id % 13 = 0 THEN 'x_error' ELSE 'x_' || speaker END AS speaker,
  t0 + (event_id % 7 - 3) * 1000000 AS t0, t1 + (event_id % 5 - 2) * 1000000 AS t1 FROM ref WHERE event_id % 11 <> 0) WHERE t1 > t0)"""
TRACKS = "track AS (SELECT strftime(ts, '%Y-%m-%d') AS clip, user_id AS track, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM events GROUP BY 1, 2)"
FRAMES = "frames AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 500 AS score, event_type, epoch_us(ts) AS t, event_id FROM events)"
CAPTIONS = "captions AS (SELECT conv_id AS clip, turn, role AS speaker, CAST(turn AS BIGINT) * 4000000 AS t0, CAST(turn AS BIGINT) * 4000000 + 6000000 AS t1, text FROM conversations)"


def merged(source: str, name: str, keys: str, where: str = "TRUE") -> str:
    """SQL that merges intervals of ``source`` by ``keys``."""
    return f"""{name} AS (SELECT {keys}, min(t0) AS t0, max(t1) AS t1, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY {keys} ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source} WHERE {where})) GROUP BY {keys}, g)"""
