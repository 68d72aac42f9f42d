"""Streams of detections and tracks give what the batch operators give, over batches, late rows and restarts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators import cluster, tracking
from timeloom.streaming import tracking as live

RULES = tracking.Rules(gap=3, iou=0.3, frames=4, size=5.0)
SCHEMA = "clip string, frame int, x1 double, y1 double, x2 double, y2 double, ms bigint"


def detections(seed: int) -> list[tuple]:
    """Faces that move, pause for a few frames, cross and end; one clip goes on long after the other."""
    rng, rows = random.Random(seed), []
    for clip in ("a", "b"):
        for _ in range(6):
            start, x, y, size = rng.randrange(60), rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([4.0, 12.0, 20.0])
            for frame in range(start, start + rng.randrange(2, 40)):
                x, y = x + rng.uniform(-2, 3), y + rng.uniform(-2, 3)
                if rng.random() < 0.75:
                    rows.append((clip, frame, x, y, x + size, y + size, (frame + 1) * 40))
    rows.sort(key=lambda r: (r[1], rng.random()))
    # every row at most 8 places (and 10 frames) out of order
    for i in range(0, len(rows) - 8, 8):
        part = rows[i : i + 8]
        rng.shuffle(part)
        rows[i : i + 8] = part
    return rows


def write(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/tmp-{name}")
    (part,) = (path / f"tmp-{name}").glob("part-*")
    (path / "in").mkdir(exist_ok=True)
    part.rename(path / "in" / f"{name:03d}.parquet")


def drain(found, path, name):
    query = found.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "state")).queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, was)


def numbered(rows) -> set[tuple]:
    """Tracks numbered without holes, by clip."""
    names: dict = {}
    for r in rows:
        names.setdefault(r.clip, set()).add(r.track)
    place = {(c, t): i for c, found in names.items() for i, t in enumerate(sorted(found))}
    return {(r.clip, place[r.clip, r.track], r.frame, r.x1, r.y1, r.x2, r.y2) for r in rows}


def test_tracks_over_restarts(rocks, tmp_path):
    rows = detections(3)
    end = [(c, 100_000, 0.0, 0.0, 9.0, 9.0, 4_000_000) for c in ("a", "b")]
    stream = lambda: live.tracks(rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ms")), ["clip"], "ts", "2 seconds", RULES)
    size = -(-len(rows) // 5)
    for i in range(5):
        write(rocks, tmp_path, rows[i * size : (i + 1) * size], SCHEMA, i)
    odd = [("a", None, 1.0, 1.0, 9.0, 9.0, 4_000_000), ("a", 5, None, 1.0, 9.0, 9.0, 4_000_000), ("a", 5, 1.0, 1.0, 9.0, 9.0, None)]
    drain(stream(), tmp_path, "first")  # stops here, with open tracks in its state
    before = rocks.read.parquet(str(tmp_path / "out")).collect()
    write(rocks, tmp_path, [*end, *odd], SCHEMA, 5)
    write(rocks, tmp_path, [(c, 200_000, 0.0, 0.0, 9.0, 9.0, 8_000_000) for c in ("a", "b")], SCHEMA, 6)
    drain(stream(), tmp_path, "second")
    found = rocks.read.parquet(str(tmp_path / "out")).collect()
    batch = tracking.tracks(rocks.createDataFrame(rows, SCHEMA), ["clip"], RULES).collect()
    assert 0 < len(before) < len(found) and len({(r.clip, r.track) for r in batch}) > 4
    assert numbered(found) == numbered(batch) and len(found) == len(batch)


def test_identities_over_batches(rocks, tmp_path):
    rng = random.Random(5)
    schema = "clip string, track int, vectors array<array<double>>, frames array<int>, ms bigint"
    rows = []
    for track in range(24):
        base = rng.choice([(1.0, 0.0, 0.1), (0.0, 1.0, 0.1), (0.1, 0.1, 1.0)])
        vectors = [[x + rng.uniform(-0.3, 0.3) for x in base] for _ in range(rng.randint(1, 3))]
        rows.append((rng.choice("ab"), track, vectors, rng.choice([None, [track // 3], [track, track + 1]]), (track + 1) * 1000))
    rows += [("a", 90, [], [1], 5000), ("a", 91, None, [1], 5000), ("b", 92, [[1.0, 0.0, 0.0]], [1], None)]
    mixed = rows[:24]
    mixed[4:8] = reversed(mixed[4:8])
    for i in range(3):
        write(rocks, tmp_path, mixed[i * 8 : (i + 1) * 8] + rows[24:], schema, i)
    for i in (3, 4):
        write(rocks, tmp_path, [("z", 1000 + i, [[1.0, 1.0, 1.0]], None, i * 1_000_000)], schema, i)
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ms"))
    drain(live.identities(stream, ["clip"], "track", "vectors", "frames", "ts", "10 seconds", 0.4), tmp_path, "identities")
    found = rocks.read.parquet(str(tmp_path / "out")).where("clip <> 'z'").collect()
    batch = cluster.identities(rocks.createDataFrame(rows[:24], schema), ["clip"], "track", "vectors", "frames", 0.4).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in batch} and len(found) == 24 and max(r.identity for r in batch) > 1
