"""Sources, sinks, signals, batches and masks on small tables, nulls included."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from timeloom.functions import decode, text, udtf
from timeloom.operators import assets, batching, cluster, search, signals, tracking, voice
from timeloom.plans import scoring
from timeloom.sources import arrays, files, models, sinks


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_archives(spark):
    rows = [("a", {"x": [1.0, 2.0], "y": [3.0, 4.0]}), ("b", {"x": [1.0]}), ("c", {"x": [1.0], "y": [1.0, 2.0]})]
    content = arrays.archives(spark.createDataFrame(rows, "stem string, m map<string,array<double>>"), "stem", "m")
    paths = content.select(F.concat(F.lit("/d/"), "stem", F.lit(".npz")).alias("path"), "content")
    broken = spark.createDataFrame([("/d/e/e.npz", bytearray(b"no archive"))], "path string, content binary")
    found = {r.stem: (r.good, r["values"]) for r in arrays.read_archives(paths.unionByName(broken), ["y", "x"], frames=3).collect()}
    zeros = [[0.0, 0.0]] * 3
    assert found == {"a": (True, [[1.0, 3.0], [2.0, 4.0], [0.0, 0.0]]), "b": (False, zeros), "c": (False, zeros), "e": (False, zeros)}
    several = spark.createDataFrame([("s", "/r/s/s.npz"), ("s", "/r/s.npz")], "stem string, path string")
    assert rows_of(arrays.one_a_stem(several), "stem", "path") == [("s", "/r/s.npz")]
    listing = spark.createDataFrame([("r1", "a/b.MP4"), ("r1", "a/b.txt")], "repo string, path string")
    assert rows_of(arrays.listed(listing, ".mp4"), "repo", "stem") == [("r1", "b")]


def test_sinks(spark, tmp_path):
    seg = spark.createDataFrame([("c", 500_000, 1_500_000, "ID_1", True), ("c", 0, 250_000, "ID_2", False)], "clip string, t0 bigint, t1 bigint, speaker string, on_screen boolean")
    project = json.loads(sinks.project_json(seg, ["clip"]).first()["value"])
    assert project["metadata"]["0"] == {"vid": "1", "z": [0.0, 0.25], "av": {"1": "ID_2"}} and set(project["metadata"]) == {"0", "1"}
    sinks.write_split(seg, f"{tmp_path}/split")
    back = {(r.screen, r.value) for r in spark.read.text(f"{tmp_path}/split").collect()}
    assert back == {("on", "SPEAKER c 1 0.500 1.000 <NA> <NA> ID_1 <NA> <NA>"), ("off", "SPEAKER c 1 0.000 0.250 <NA> <NA> ID_2 <NA> <NA>")}
    for part in ([(1, "a"), (2, "b")], [(2, "other"), (3, "c")], []):
        sinks.append_results(spark.createDataFrame(part, "id int, x string"), f"file://{tmp_path}/results", "id")
    assert rows_of(spark.read.json(f"{tmp_path}/results"), "id", "x") == [(1, "a"), (2, "b"), (3, "c")]
    lines = sinks.with_header(spark.createDataFrame([(7,)], "id int"), {"seed": "42"}).orderBy("part").collect()
    assert [json.loads(r["value"]) for r in lines] == [{"_meta": {"seed": "42"}}, {"id": 7}]
    summary = sinks.run_summary(spark.createDataFrame([(3, 0.5)], "n int, rate double"), {"model": "m"}).first()["value"]
    assert json.loads(summary) == {"run": {"model": "m"}, "summary": {"n": 3, "rate": 0.5}}
    assert spark.range(1).select(sinks.fail_line(F.lit("a/b"), F.lit("bad"), F.lit("x, y"))).first()[0] == "a/b,bad,x; y"


def test_report_json(spark):
    scores = spark.createDataFrame([("b", 10, 50.0, 50.0, 0.0, 0.0), ("a", 30, 10.0, 0.0, 10.0, 0.0)], "clip string, total_us bigint, der double, miss double, fa double, conf double")
    found = json.loads(scoring.report_json(scores, spark.createDataFrame([("z",)], "clip string"), 250_000).first()["value"])
    assert found["n_clips"] == 2 and found["skipped"] == ["z"] and found["collar"] == 0.25 and [c["clip"] for c in found["per_clip"]] == ["a", "b"]
    assert found["macro"]["der"] == 30.0 and found["micro"]["der"] == 20.0


def test_report_json_writes_digits(spark):
    """Small and large scores without a power of ten, and names of any characters."""
    scores = spark.createDataFrame([('q"\\]', 10, 0.0001, 0.000001, 12345678.5, -0.00005), (None, 10, 0.0, 0.0, 0.0, 0.0)], "clip string, total_us bigint, der double, miss double, fa double, conf double")
    value = scoring.report_json(scores, spark.createDataFrame([], "clip string"), 0).first()["value"]
    assert '"der":0.0001,"miss":0.000001,"fa":12345678.5,"conf":-0.00005,"total_us":10}' in value and "E" not in value
    assert [c["clip"] for c in json.loads(value)["per_clip"]] == [None, 'q"\\]'] and json.loads(value)["skipped"] == []


def test_median_interval(spark):
    rng = np.random.default_rng(2)
    for n in (41, 60):
        d = rng.normal(0.2, 1.0, n)
        found = scoring.median_interval(spark.createDataFrame([(float(x),) for x in d] + [(None,)], "d double"), "d").first()
        draws = np.sort([np.median(rng.choice(d, n)) for _ in range(10_000)])
        assert found.n == n and abs(found.point - np.median(d)) < 1e-9
        assert abs(found.low - draws[250]) < 0.12 and abs(found.high - draws[9750]) < 0.12
    few = scoring.median_interval(spark.createDataFrame([(1.0,), (2.0,)], "d double"), "d").first()
    assert (few.n, few.point, few.low, few.high) == (2, 1.5, None, None)


def test_numbers_in_order(spark):
    rows = [(i * 7 % 100,) for i in range(100)]
    found = assets.numbered(spark.createDataFrame(rows, "x int").repartition(5), ["x"])
    assert rows_of(found, "x", "n") == [(i, i + 1) for i in range(100)]
    assert assets.numbered(spark.createDataFrame([], "x int"), ["x"]).count() == 0


def test_tracks_by_detections_and_mean_side(spark):
    rules = tracking.Rules(frames=2, size=40)
    apart = [(20 * i, 0.0, 0.0, 90.0, 90.0) for i in range(3)]
    assert len(tracking.follow(apart, rules)) == 1 and not tracking.follow(apart, tracking.Rules(frames=30, size=40))
    turning = [(i, 0.0, 0.0, *((60.0, 20.0) if i % 2 else (20.0, 60.0))) for i in range(10)]
    assert not tracking.follow(turning, tracking.Rules(frames=2, size=41, iou=0.1)) and tracking.follow(turning, tracking.Rules(frames=2, size=39, iou=0.1))
    shots = spark.createDataFrame([("c", 0, 0, 40), ("c", 1, 40, 100)], "clip string, shot int, f0 int, f1 int")
    seen = spark.createDataFrame([("c", 39), ("c", 40), ("c", 99), ("c", 100)], "clip string, frame int")
    assert rows_of(tracking.in_shots(seen, shots, ["clip"]), "shot", "frame") == [(1, 40), (1, 99)]


def test_a_forced_cut_opens_nothing():
    rules = voice.Hysteresis(on=0.5, least=1, silence=2, most=4, pad=0)
    assert voice.speech([(i, 0.9) for i in range(10)], rules) == [(0, 4), (5, 9)]


def test_null_rows_are_left_out(spark):
    v = spark.createDataFrame([("c", 1, [1.0, 0.0], [[1.0, 0.0]], [1]), ("c", 2, None, None, None), ("c", 3, [1.0, 0.1], [[1.0, 0.1]], None)], "clip string, m int, v array<double>, vs array<array<double>>, f array<int>")
    assert rows_of(cluster.linked(v, ["clip"], "m", "v", 0.5, "f"), "m", "cluster") == [(1, 0), (3, 0)]
    assert rows_of(cluster.identities(v, ["clip"], "m", "vs", "f", 0.5), "m", "identity") == [(1, 0), (3, 0)]
    table = spark.createDataFrame([("c", 0, [-1.0, -2.0]), ("c", 1, None)], "clip string, step int, scores array<double>")
    assert search.ctc(table, "clip", "step", "scores", [1]).first()["score"] == pytest.approx(-2.0)
    assert search.beam(table, "clip", "step", "scores", beam=1, eos=1).count() == 1
    sizes = spark.createDataFrame([("s", 1, 5), ("s", 2, None), ("s", 3, 4)], "shard string, k int, n int")
    assert rows_of(batching.by_size(sizes, ["shard"], "k", "n", 10, 4), "k", "batch") == [(1, 0), (3, 0)]
    fixed = batching.by_shapes(sizes.unionByName(spark.createDataFrame([("s", 4, 99), ("s", 5, 3), ("s", 6, 2)], sizes.schema)), ["shard"], "k", "n", [(2, 4), (1, 9)])
    assert rows_of(fixed, "k", "shape", "batch") == [(1, 1, 0), (3, 0, 0), (5, 0, 0), (6, 0, 1)]


def test_batches_are_dealt_out(spark):
    b = spark.range(10).withColumnRenamed("id", "batch")
    one, two = (rows_of(batching.dealt_batches(b, "batch", 3, 1, e), "replica", "turn", "batch") for e in (0, 1))
    assert [r[:2] for r in one] == [(i % 3, i // 3) for i in sorted(range(10), key=lambda i: (i % 3, i))] and one != two
    rows = spark.createDataFrame([("s", 2, [[3.0]]), ("s", 1, [[1.0], [2.0]])], "k string, o int, r array<array<double>>").withColumn("n", F.lit(6))
    assert batching.stitched(rows, ["k"], "o", "r", 1, F.col("n"), 1).first()["r"] == [[1.0], [2.0], [0.0], [3.0], [0.0], [0.0]]


def test_signals(spark):
    df = spark.createDataFrame([("c", i, [1.0, float(i)], [1.0, float(i)]) for i in range(4)], "clip string, frame int, a array<double>, b array<double>")
    d = signals.shifted_distances(df, ["clip"], "a", "b", 1)
    table = {r.frame: r.d for r in d.collect()}
    assert table[0][0] == 1.0 and table[0][1] == pytest.approx(0.0) and table[3][2] == 1.0
    plain, wide = (rows_of(signals.sync_confidence(d, ["clip"], "d", edge=e), "frame", "confidence") for e in (0, 2))
    assert len(plain) == 4 and [f for f, _ in wide] == list(range(-2, 6)) and wide[0][1] < -5 and wide[2:6] == plain
    points = spark.createDataFrame([("c", i, float(i * i), 2.0 * i, float(i * i) + 3, 1.0) for i in range(7)], "clip string, frame int, x1 double, y1 double, x2 double, y2 double")
    found = {r.frame: r for r in signals.recentred(points, ["clip"], {"x1": "y1", "x2": "y2"}, 2).collect()}
    for r in points.collect():
        assert found[r.frame].x1 + found[r.frame].x2 == pytest.approx(r.x1 + r.x2) and found[r.frame].x2 - found[r.frame].x1 == pytest.approx(3.0)
    sets = spark.createDataFrame([("p", "w", [1.0, 3.0]), ("q", "w", [3.0, 5.0]), ("r", "other", [9.0])], "ck string, k string, v array<double>")
    assert rows_of(signals.average_checkpoints(sets, "ck", "k", "v"), "k", "i", "x") == [("w", 0, 2.0), ("w", 1, 4.0)]
    feats = spark.createDataFrame([("c", f, [float(f)]) for f in range(100)], "clip string, frame int, v array<double>")
    seg = spark.createDataFrame([("c", 1, 40_000, 120_000), ("c", 1, 160_000, 200_000)], "clip string, track int, t0 bigint, t1 bigint")
    assert signals.slice_of_track(feats, seg, ["clip"], "track").first()["features"] == [[1.0], [2.0], [3.0], [4.0]]


def test_sources(spark, tmp_path):
    seg = spark.createDataFrame([("c", "c", 1), ("c", "x", 2), ("d", "z", 3), ("d", "y", 4)], "clip string, file_id string, n int")
    clips = spark.createDataFrame([("c",), ("d",), ("e",)], "clip string")
    assert rows_of(files.annotation(seg, clips), "clip", "n") == [("c", 1), ("d", 4)]
    (tmp_path / "t.json").write_text('[{"track_idx": 1, "start": 0.5, "end": 1.25, "speaker": "ID_1"}]')
    assert rows_of(files.segment_tracks(spark, str(tmp_path / "t.json")), "track_idx", "t0", "t1", "speaker") == [(1, 500_000, 1_250_000, "ID_1")]
    audio = spark.createDataFrame([("a", bytearray(range(9))), ("b", bytearray(2))], "key string, content binary")
    assert rows_of(files.pcm_frames(audio, 1000, 2), "key", "frame") == [("a", 0), ("a", 1)]
    raw = spark.createDataFrame([(1, "tag,a\\b.mp4"), (2, "t,c,x,1 2"), (3, "lonely"), (4, "t,d,7")], "line int, value string")
    assert rows_of(files.manifest_paths(raw), "tag", "rel") == [("t", "c"), ("t", "d"), ("tag", "a/b.mp4")]
    assert rows_of(files.numbered_manifest(raw), "line", "frames") == [(2, -1), (4, 7)]
    contract = models.Contract(("clip",), "clip string, pair struct<a:int,b:int>")
    held = models.apply(clips, contract, lambda pdf: pd.DataFrame({"extra": 1, "clip": pdf["clip"], "pair": [{"a": 1, "b": 2}] * len(pdf)}))
    assert {tuple(r.pair) for r in held.collect()} == {(1, 2)}


def test_masks_and_text(spark):
    df = spark.createDataFrame([(k, [1.0] * 20, [[1.0] * 6] * 3) for k in range(30)] + [(99, [], [[]])], "k bigint, v array<double>, m array<array<double>>")
    masked = decode.time_masked(F.col("v"), F.col("k"), 2, F.lit(5), seed=3)
    found = df.select("k", masked.alias("x"), decode.time_masked(F.col("v"), F.col("k"), 2, F.lit(5), 3, mean=True).alias("same"), decode.frequency_masked(F.col("m"), F.col("k"), 1, 3).alias("f")).collect()
    zeros = [r.x.count(0.0) for r in found if r.k < 99]
    assert max(zeros) <= 10 and len(set(zeros)) > 3 and all(r.same == [1.0] * 20 for r in found if r.k < 99) and found[-1].x == []
    assert all(len({tuple(row) for row in r.f}) == 1 and r.f[0].count(0.0) <= 3 for r in found)
    assert found == df.select("k", masked.alias("x"), decode.time_masked(F.col("v"), F.col("k"), 2, F.lit(5), 3, mean=True).alias("same"), decode.frequency_masked(F.col("m"), F.col("k"), 1, 3).alias("f")).collect()
    assert spark.range(1).select(decode.adaptive_spans(F.lit(60)), decode.adaptive_spans(F.lit(9000))).first() == (3, 10)
    good = spark.createDataFrame([("v_c_01",)], "c string").select(*text.strict_clip_parts(F.col("c"))).first()
    assert tuple(good) == ("v", "01")
    with pytest.raises(Exception, match="no clip id: w"):
        spark.createDataFrame([("w",)], "c string").select(*text.strict_clip_parts(F.col("c"))).collect()


def test_table_function(spark):
    udtf.register(spark)
    spark.createDataFrame([(1, "ID_3/7"), (2, "unknown"), (3, None), (4, "ID_-1")], "n int, speaker string").createOrReplaceTempView("named_speakers")
    found = spark.sql("SELECT n, place, face FROM named_speakers, LATERAL speaker_faces(speaker)")
    assert rows_of(found, "n", "place", "face") == [(1, 0, 3), (1, 1, 7), (4, 0, -1)]
