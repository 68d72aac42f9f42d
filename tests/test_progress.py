"""Progress of streams: rows, late rows, ends and errors, as a callback gets them."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.streaming import progress, sessions

SCHEMA = "user_id int, s bigint"


def write(spark, path, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in")).withColumn("ts", F.timestamp_seconds("s"))


def test_rows_and_late_rows(spark, tmp_path):
    seen: list[progress.Report] = []
    parts = [[(1, 1000), (1, 1010)], [(1, 5000)], [(2, 5000)], [(1, 1020), (2, 1030), (2, 6000)], [(3, 9000)]]
    found = progress.follow(spark, seen.append, {"late_rows": 8})
    try:
        stream = sessions.islands(write(spark, tmp_path, parts), "user_id", "ts", "60 seconds", "60 seconds")
        query = stream.writeStream.format("memory").queryName("late_rows").trigger(availableNow=True).start()
        query.awaitTermination(120)
        last = found.wait(query)
    finally:
        spark.streams.removeListener(found)
    # the fourth file's first two rows are behind the watermark of 4940 seconds, which holds for late rows one batch after it is reached
    assert (last.rows, last.late, last.over, last.error, last.percent) == (8, 2, True, None, 100.0) and last.batches == 5
    own = [r for r in seen if r.name == "late_rows"]
    assert [r.rows for r in own] == sorted(r.rows for r in own) and own[0].percent == 25.0 and own[-1] == last and last.watermark >= "1970-01-01T02"
    assert spark.table("late_rows").count() == 4 and found.report("late_rows") == last and found.report("other") is None


def test_hopping_windows_with_late_rows(spark, tmp_path):
    """Windows of 20 seconds every 10, counted once each, without rows that came too late."""
    rows = [[(1, 100), (1, 105), (2, 119)], [(1, 400)], [(1, 410)], [(1, 101), (1, 395)], [(1, 2000)]]
    found = progress.follow(spark)
    try:
        stream = sessions.hopping(write(spark, tmp_path, rows), "user_id", "ts", "20 seconds", "10 seconds", "30 seconds")
        query = stream.writeStream.format("memory").queryName("hops").trigger(availableNow=True).start()
        query.awaitTermination(120)
        last = found.wait(query)
    finally:
        spark.streams.removeListener(found)
    want = {}
    for user, s in [(1, 100), (1, 105), (2, 119), (1, 400), (1, 410), (1, 395)]:
        for t0 in (s // 10 * 10 - 10, s // 10 * 10):
            want[user, t0 * 1_000_000] = want.get((user, t0 * 1_000_000), 0) + 1
    assert {(r.user_id, r.t0): r.n for r in spark.table("hops").collect()} == want
    assert last.late == 2  # the row of second 101, once for each of its windows


def test_a_failing_stream_and_callback(spark, tmp_path):
    def angry(report):
        raise RuntimeError("no")

    found = progress.follow(spark, angry)
    try:
        stream = write(spark, tmp_path, [[(1, 0)], [(2, 0)]]).select(F.when(F.col("user_id") == 2, F.raise_error(F.lit("bad row"))).otherwise(F.lit("x")).alias("x"))
        query = stream.writeStream.format("memory").queryName("fails").trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception:  # noqa: BLE001, S110
            pass
        last = found.wait(query)
    finally:
        spark.streams.removeListener(found)
    assert last.over and "bad row" in last.error and last.percent is None and last.rows == 1
