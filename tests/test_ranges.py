"""Recordings and archives read by ranges give what a loop over the whole file gives."""

from __future__ import annotations

import io
import wave

import numpy as np
import pytest

from timeloom.sources import ranges


def windows(samples: np.ndarray, size: int, hop: int, channels: int, last: str) -> list[list[int]]:
    out = []
    n = len(samples) // channels
    for a in range(0, n, hop):
        part = samples[a * channels : (a + size) * channels]
        if len(part) < size * channels and last == "drop":
            continue
        out.append(np.concatenate([part, np.zeros(size * channels - len(part), part.dtype)]).tolist())
    return out


@pytest.mark.parametrize(("size", "hop", "channels", "last"), [(512, 512, 1, "pad"), (512, 160, 1, "pad"), (100, 250, 1, "pad"), (64, 16, 2, "drop")])
def test_windows_equal_a_loop(spark, tmp_path, size, hop, channels, last):
    rng = np.random.default_rng(size)
    files = {"a.pcm": 20_001, "b.pcm": 333, "empty.pcm": 0, "sub/c.pcm": 4096}
    held = {}
    for name, n in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        held[name] = rng.integers(-32768, 32767, n * channels).astype("<i2")
        (tmp_path / name).write_bytes(held[name].tobytes() + b"x")  # half a sample too many
    found = ranges.recordings(spark, str(tmp_path), window=size, hop=hop, channels=channels, last=last, rangeBytes=3000, rate=16000)
    assert found.rdd.getNumPartitions() > 5
    rows: dict = {}
    for r in found.collect():
        rows.setdefault(r.path.removeprefix(f"{tmp_path}/"), []).append(r)
    for name in files:
        own = sorted(rows.get(name, []), key=lambda r: r.window)
        assert [list(r.samples) for r in own] == windows(held[name], size, hop, channels, last)
        assert [(r.window, r.t0) for r in own] == [(i, i * hop * 1_000_000 // 16000) for i in range(len(own))]


def test_wave_files(spark, tmp_path):
    samples = np.arange(5000, dtype="<i2")
    with wave.open(str(tmp_path / "x.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(samples.tobytes())
    rows = ranges.recordings(spark, str(tmp_path / "x.wav"), window=700, rangeBytes=1000).orderBy("window").collect()
    assert [list(r.samples) for r in rows] == windows(samples, 700, 700, 2, "pad") and rows[1].t0 == 700 * 1_000_000 // 8000
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVEfmt ")
    with pytest.raises(Exception, match="RIFF|buffer"):
        ranges.recordings(spark, str(tmp_path / "bad.wav")).collect()


def test_choice_of_windows(spark, tmp_path):
    samples = np.arange(10_000, dtype="<i2")
    (tmp_path / "a.pcm").write_bytes(samples.tobytes())
    (tmp_path / "b.pcm").write_bytes(samples.tobytes())
    found = ranges.recordings(spark, str(tmp_path), window=100, rangeBytes=400, from_=30, to=34)
    assert sorted(r.window for r in found.collect()) == [30, 30, 31, 31, 32, 32, 33, 33] and found.rdd.getNumPartitions() == 4
    key = "spark.sql.python.filterPushdown.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        pushed = ranges.recordings(spark, str(tmp_path), window=100, rangeBytes=400, pushdown=True).where(f"path = '{tmp_path}/b.pcm' AND window >= 10 AND window < 14 AND samples[0] > 1000")
        assert sorted(r.window for r in pushed.collect()) == [11, 12, 13] and pushed.rdd.getNumPartitions() == 2
    finally:
        spark.conf.set(key, was)


def test_a_range_reads_its_bytes_only(tmp_path):
    """A task's batches hold its own windows, whatever the file's size; the file is 1 GB of zeros that take no room."""
    with open(tmp_path / "long.pcm", "wb") as f:
        f.truncate(1 << 30)
    reader = ranges.PcmReader({"path": str(tmp_path), "window": "512", "hop": "256"})
    parts = reader.partitions()
    assert len(parts) == 64 and sum(p.hi - p.lo for p in parts) == (1 << 29) // 256
    sizes = [b.nbytes for b in reader.read(parts[40])]
    assert max(sizes) < 4 << 20 and sum(b.num_rows for b in reader.read(parts[-1])) == parts[-1].hi - parts[-1].lo


def archive(compressed: bool = False, **arrays) -> bytes:
    out = io.BytesIO()
    (np.savez_compressed if compressed else np.savez)(out, **arrays)
    return out.getvalue()


def test_archives_equal_numpy(spark, tmp_path):
    rng = np.random.default_rng(1)
    tables = {f"{i}.npz": {"x": rng.normal(size=n).astype(kind), "y": rng.normal(size=n), "other": np.zeros(5)} for i, (n, kind) in enumerate([(5000, "f4"), (1, "f8"), (0, "f4"), (3000, "f2")])}
    for i, (name, arrays) in enumerate(tables.items()):
        (tmp_path / name).write_bytes(archive(bool(i == 3), **arrays))
    broken = {"short.npz": archive(x=np.zeros(3), y=np.zeros(4)), "lacks.npz": archive(x=np.zeros(3)), "noise.npz": b"no archive", "objects.npz": archive(x=np.array([None, 1]), y=np.zeros(2))}
    for name, raw in broken.items():
        (tmp_path / name).write_bytes(raw)
    found = ranges.archives(spark, str(tmp_path), ["y", "x"], rangeBytes=2000)
    assert found.columns == ["path", "frame", "y", "x"] and found.rdd.getNumPartitions() > 20
    rows = {(r.path.rsplit("/", 1)[-1], r.frame): (r.y, r.x) for r in found.collect()}
    assert rows == {(name, i): (float(y), float(x)) for name, t in tables.items() for i, (y, x) in enumerate(zip(t["y"], t["x"], strict=True))}
    part = ranges.archives(spark, str(tmp_path / "0.npz"), ["x"], rangeBytes=2000, from_=1000, to=1003)
    assert [r.x for r in part.orderBy("frame").collect()] == tables["0.npz"]["x"][1000:1003].tolist()
    for name, what in (("short", "length"), ("lacks", "no array y"), ("noise", "noise.npz"), ("objects", "numbers")):
        with pytest.raises(Exception, match=what):
            ranges.archives(spark, str(tmp_path / f"{name}.npz"), ["x", "y"], mode="FAILFAST").collect()


def test_missing_folders_and_options(spark, tmp_path):
    assert ranges.recordings(spark, str(tmp_path)).count() == 0 and ranges.archives(spark, str(tmp_path), ["x"]).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        ranges.recordings(spark, str(tmp_path / "nowhere")).count()
    with pytest.raises(ValueError, match="arrays"):
        ranges.NpzReader({"path": "x"})
    with pytest.raises(ValueError, match="window"):
        ranges.PcmReader({"path": "x", "hop": "0"})
