"""Streams give what the batch operators give on time-ordered input."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.operators import intervals, voice
from timeloom.streaming import sessions


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def ordered_files(spark, tmp_path, rows, schema, parts):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_islands(spark, tmp_path):
    times = [0, 10, 20, 200, 205, 1000, 5000]
    rows = [(k, t) for t in times for k in (1, 2)] + [(3, 100_000)]
    schema = "user_id int, s bigint"
    stream = ordered_files(spark, tmp_path, rows, schema, 3).withColumn("ts", F.timestamp_seconds("s"))
    found = run(sessions.islands(stream, "user_id", "ts", "60 seconds", "60 seconds"), "islands")
    batch = intervals.islands(spark.createDataFrame(rows, schema).withColumn("t", F.col("s") * 1_000_000), ["user_id"], "t", 59_999_999)
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in batch.where("user_id < 3").collect())


def test_once(spark, tmp_path):
    rows = [(1, 0), (1, 5), (2, 6), (2, 7)]
    stream = ordered_files(spark, tmp_path, rows, "id int, s bigint", 2).withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in run(sessions.once(stream, ["id"], "ts", "1 hour"), "once").collect()) == [1, 2]


def test_speech(spark, tmp_path):
    p = [0.1] * 3 + [0.9] * 10 + [0.1] * 6
    rows = [("a", i, x) for i, x in enumerate(p)]
    rules = voice.Hysteresis(pad=0)
    stream = ordered_files(spark, tmp_path, rows, "src string, frame int, score double", 1)
    found = run(sessions.speech(stream, "src", "frame", "score", rules), "speech")
    assert [(r.start, r.stop) for r in found.collect()] == voice.speech(enumerate(p), rules) == [(3, 13)]
