"""Manifest builds against a loop over clips, over resumed and killed runs."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from timeloom.functions import text as X
from timeloom.operators import manifest


def encode(text):
    return X.word_ids(X.whole_words(text), F.create_map(F.lit("A"), F.lit(2)), 1)


def world(seed: int):
    """Clips in three shards with everything that can be wrong with one."""
    rng = random.Random(seed)
    clips = [(f"{rng.randrange(3):02d}", f"s{i % 70}") for i in range(90)]
    text = {c: rng.choice(["a b c", "a", "", "...", None]) for c in clips if rng.random() < 0.85}
    files = [(shard, f"{stem}/{stem}{ext}") for shard, stem in clips for ext in (".wav", ".avi", ".txt") if rng.random() < 0.85] + [("00", "s1/other.wav"), ("00", "loose.avi"), ("00", None)]
    count = {c: rng.choice([None, 0, -3, 25, 99]) for c in clips if rng.random() < 0.9}
    return clips, text, files, count


def loop(clips, text, files, count, done, rules):
    """The same, clip by clip in the order of shards."""
    counts = dict.fromkeys((*manifest.REASONS, "train", "val"), 0)
    done, lines = set(done), []
    for shard, stem in sorted(set(clips)):
        key = f"{stem}/{stem}.mp4"
        t = text.get((shard, stem))
        ids = ["2" if w == "A" else "1" for w in (t or "").replace(".", " ").upper().split()]
        n = count.get((shard, stem)) or 0
        there = {p for s, p in files if s == shard}
        for reason, bad in (("already", key in done), ("missing_transcript", (shard, stem) not in text), ("empty_text", not t), ("empty_ids", not ids), ("missing_wav", f"{stem}/{stem}.wav" not in there), ("missing_avi", f"{stem}/{stem}.avi" not in there), ("missing_frames", n <= 0 and rules.need_frames)):
            if bad:
                counts[reason] += 1
                break
        else:
            u = int(hashlib.sha256(f"{rules.seed}|{key}".encode()).hexdigest()[:16], 16) / 2**64
            split = "val" if u < rules.validation else "train"
            counts[split] += 1
            done.add(key)
            lines.append((key, split, f"set_{shard},{stem}/{stem}.avi,{max(n, 0)},{' '.join(ids)}"))
    return counts, sorted(lines)


def tables(spark, clips, text, files, count):
    three = "shard string, stem string"
    return (
        spark.createDataFrame(clips, three), spark.createDataFrame([(*c, t) for c, t in text.items()], f"{three}, text string"), spark.createDataFrame(files, "shard string, path string"),
        spark.createDataFrame([(*c, n) for c, n in count.items()], f"{three}, frames int"),
    )


@pytest.mark.parametrize("rules", [manifest.Rules(validation=0.3), manifest.Rules(validation=0.0, need_frames=False)])
def test_a_build_equals_the_loop(spark, tmp_path, rules):
    parts = world(2)
    counts, lines = loop(*parts, (), rules)
    folder = str(tmp_path / "m")
    assert manifest.build(folder, *tables(spark, *parts), encode, rules) == counts
    rows = manifest.log(spark, folder).read()
    assert sorted(map(tuple, rows.collect())) == lines and all(v for k, v in counts.items() if k not in ("already", "landmarks", "val", "missing_frames"))
    # nothing is made twice, and what has become whole since is added
    again, _ = loop(*parts, [k for k, *_ in lines], rules)
    assert manifest.build(folder, *tables(spark, *parts), encode, rules) == again and again["train"] == again["val"] == 0
    better = (parts[0], dict.fromkeys(parts[0], "a b"), *parts[2:])
    more, extra = loop(*better, [k for k, *_ in lines], rules)
    assert manifest.build(folder, *tables(spark, *better), encode, rules) == more and extra
    assert sorted(map(tuple, manifest.log(spark, folder).read().collect())) == sorted(lines + extra)
    manifest.export(folder, str(tmp_path / "out"), spark)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(x for *_, x in lines + extra)
    assert manifest.build(folder, *tables(spark, *parts), encode, rules, fresh=True) == counts


def test_a_killed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    parts, folder, rules = world(3), str(tmp_path / "m"), manifest.Rules()
    counts, lines = loop(*parts, (), rules)

    def killed(self, run, counters):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(manifest.RunLog, "commit", killed)  # all rows are written, the marker is not
        with pytest.raises(KeyboardInterrupt):
            manifest.build(folder, *tables(spark, *parts), encode, rules)
    (tmp_path / "m" / "runs" / "000002").mkdir()  # one that died while it wrote
    (tmp_path / "m" / "runs" / "000002" / "part-0.parquet").write_bytes(b"half")
    runs = manifest.log(spark, folder)
    assert runs.committed() == [] and runs.read().count() == 0
    assert manifest.build(folder, *tables(spark, *parts), encode, rules) == counts
    assert runs.committed() == [3] and sorted(map(tuple, runs.read().collect())) == lines
    with pytest.raises(Exception, match="exists"):
        runs.commit(3, {})  # another writer's number


def test_landmarks_and_odd_rows(spark, tmp_path):
    clips = [("00", "a"), ("00", "b"), ("00", "b"), (None, "c"), ("01", "a")]
    parts = tables(spark, clips, {("00", "a"): "a", ("00", "b"): "a", ("01", "a"): "a"}, [(s, f"{x}/{x}{e}") for s, x in clips if s for e in (".avi", ".wav")] * 2, {("00", "a"): 5, ("00", "b"): 6, ("01", "a"): 7})
    marks = spark.createDataFrame([("00", "a", True), ("00", "a", False), ("00", "b", None)], "shard string, stem string, good boolean")
    found = manifest.build(str(tmp_path / "a"), *parts, encode, manifest.Rules(landmarks=True, video_ext=".mp4"), marks)
    assert (found["train"] + found["val"], found["landmarks"], found["already"]) == (1, 1, 1)
    assert manifest.log(spark, str(tmp_path / "a")).read().first().line == "set_00,a/a.mp4,5,2"
    assert manifest.build(str(tmp_path / "b"), *parts, encode)["already"] == 1  # the stem of two shards
    none = manifest.build(str(tmp_path / "c"), *(x.limit(0) for x in parts), encode)
    assert set(none.values()) == {0}


def test_media_are_resolved_in_order(spark):
    listing = spark.createDataFrame([("hub", "x/a.avi"), ("hub", "x/b.mp4"), ("disk", "/data/x/b.avi"), ("disk", "/data/x/c.wav"), ("disk", "/data/x/c.wav"), ("hub", "noext.avi"), ("hub", ".hidden.avi")], "place string, path string")
    media = spark.createDataFrame([(1, "x\\a.mp4"), (2, "x/b.mp4"), (3, "x/c.mp4"), (4, "x/d.mp4"), (5, None), (6, "noext"), (7, "x/b.mp4"), (8, ".hidden"), (None, "x/a.avi")], "key int, path string")
    found = {r.key: (r.place, r.found) for r in manifest.resolved(media, listing, [("hub", ""), ("disk", "/data/")], ["", ".avi", ".wav"]).collect()}
    assert found == {1: ("hub", "x/a.avi"), 2: ("hub", "x/b.mp4"), 3: ("disk", "/data/x/c.wav"), 4: (None, None), 5: (None, None), 6: ("hub", "noext.avi"), 7: ("hub", "x/b.mp4"), 8: ("hub", ".hidden.avi"), None: ("hub", "x/a.avi")}
    other = {r.key: r.found for r in manifest.resolved(media, listing, [("disk", "/data/"), ("hub", "")], [".avi"]).collect()}
    assert other[2] == "/data/x/b.avi" and other[1] == "x/a.avi" and other[3] is None
