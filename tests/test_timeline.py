"""Interval algebra, scorers, sources and state machines on small cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.functions import arrays, masks
from timeloom.functions import text as X
from timeloom.operators import batching, captions, cluster, intervals, search, tokens, tracking, voice
from timeloom.operators.assignment import assign
from timeloom.plans import scoring
from timeloom.sources import files, sinks

SECOND = 1_000_000
SEGMENTS = "clip string, speaker string, t0 bigint, t1 bigint"
REFERENCE = [("c", "A", 0, 5), ("c", "B", 5, 10), ("c", "A", 10, 20)]


def segments(spark, rows):
    return spark.createDataFrame([(c, s, a * SECOND, b * SECOND) for c, s, a, b in rows], SEGMENTS)


@pytest.mark.parametrize(
    ("hypothesis", "expected"),
    [
        ([("c", "x0", 0, 5), ("c", "x1", 5, 10), ("c", "x0", 10, 20)], (0, 0, 0, 0)),
        ([("c", "y1", 0, 5), ("c", "y0", 5, 10), ("c", "y1", 10, 20)], (0, 0, 0, 0)),
        ([("c", "x0", 0, 5), ("c", "x0", 10, 20)], (25, 25, 0, 0)),
        ([("c", "x0", 0, 5), ("c", "x1", 5, 10), ("c", "x0", 10, 20), ("c", "g", 20, 25)], (25, 0, 25, 0)),
        ([], (100, 100, 0, 0)),
    ],
)
def test_error_rates(spark, hypothesis, expected):
    r, h = segments(spark, REFERENCE), segments(spark, hypothesis)
    row = scoring.error_rates(r, h).first()
    assert (row.der, row.miss, row.fa, row.conf) == expected and row.total_us == 20 * SECOND
    if expected == (0, 0, 0, 0):
        assert scoring.jaccard_errors(r, h).first().jer == 0


def test_report_of_two_clips(spark):
    r = segments(spark, [("a", "A", 0, 20), ("b", "A", 0, 20)])
    scores = scoring.error_rates(r, segments(spark, [("a", "x", 0, 20), ("b", "x", 0, 10)]))
    row = scoring.report(scores).first()
    assert row.clips == 2 and row.macro_der == row.micro_der == 25
    lines = [x.line for x in scoring.markdown(scores).orderBy("part", "name").collect()]
    assert lines[1] == "| a | 0.00 | 0.00 | 0.00 | 0.00 |" and lines[-1].startswith("| **micro** | 25.00")


def test_collar_and_overlap(spark):
    r = segments(spark, [("c", "A", 0, 10), ("c", "B", 8, 14)])
    h = segments(spark, [("c", "x", 1, 10), ("c", "y", 8, 14)])
    assert scoring.error_rates(r, h, collar=2 * SECOND).first().der == 0
    row = scoring.error_rates(r, h, skip_overlap=True).first()
    assert row.total_us == 12 * SECOND and row.miss_us == SECOND


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        gain = rng.integers(0, 20, (n, m))
        wide = gain if n <= m else gain.T
        best = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        assert sum(gain[i, j] for i, j in assign(gain)) == best
    assert assign(np.zeros((0, 0))) == []


def test_merge_properties(spark):
    rng = random.Random(2)
    rows = [("c", rng.choice("AB"), s, s + rng.randint(0, 8)) for s in (rng.randrange(60) for _ in range(60))]
    d = segments(spark, rows)
    once = intervals.merge(d, ["clip", "speaker"])
    got = sorted(tuple(r) for r in once.collect())
    assert got == sorted(tuple(r) for r in intervals.merge(once, ["clip", "speaker"]).collect())
    for s in "AB":
        mine = [(a, b) for _, x, a, b in got if x == s]
        assert all(b < c for (_, b), (c, _) in zip(mine, mine[1:], strict=False))
        covered = {t for _, x, a, b in rows if x == s for t in range(a, b)}
        assert sum(b - a for a, b in mine) == len(covered) * SECOND
    pairs = intervals.join(d, d, ["clip"], 7 * SECOND).count()
    assert pairs == sum(a[2] < b[3] and b[2] < a[3] for a in rows for b in rows)
    winners = sorted((r.t0, r.t1) for r in intervals.single_winner(d, ["clip"], "speaker", 5 * SECOND).collect())
    assert all(b <= c for (_, b), (c, _) in zip(winners, winners[1:], strict=False))


def test_empty_tables(spark):
    e = segments(spark, [])
    assert intervals.merge(e, ["clip"]).count() == intervals.single_winner(e, ["clip"], "speaker", SECOND).count() == 0
    assert scoring.error_rates(e, e).count() == 0 and scoring.report(scoring.error_rates(e, e)).first().macro_der == 0


def test_word_errors(spark):
    rng = random.Random(7)
    words = [([rng.choice("abcd") for _ in range(rng.randint(0, 7))], [rng.choice("abcd") for _ in range(rng.randint(0, 7))]) for _ in range(40)]

    def brute(r, h):
        row = list(range(len(h) + 1))
        for i, x in enumerate(r, 1):
            old, row = row, [i]
            for j, y in enumerate(h, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    d = spark.createDataFrame(words, "r array<string>, h array<string>").select("r", "h", scoring.word_errors(F.col("r"), F.col("h")).alias("e"))
    assert all(x.e == brute(x.r, x.h) for x in d.collect())
    rate = spark.range(1).select(scoring.error_rate(F.lit(0), F.lit(0)).alias("a"), scoring.error_rate(F.lit(2), F.lit(0)).alias("b")).first()
    assert (rate.a, rate.b) == (0.0, 1.0)


def test_rttm_source(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER a 1 0.50 1.25 <NA> <NA> ID_0/3 <NA> <NA>\nSPEAKER a 1 x 1 <NA> <NA> s <NA> <NA>\nSPEAKER a 1 1 0 <NA> <NA> s <NA> <NA>\nSPEAKER a 1\n\nLEXEME a 1 1 1 a b c\n")
    rows = files.rttm(spark, str(tmp_path)).collect()
    assert [(r.file_id, r.speaker, r.t0, r.t1) for r in rows] == [("a", "ID_0/3", 500_000, 1_750_000)]
    assert files.rttm(spark, str(tmp_path), positive=False).count() == 2
    d = segments(spark, REFERENCE)
    sinks.write_rttm(d, str(tmp_path / "out"))
    back = files.rttm(spark, str(tmp_path / "out" / "*"))
    assert sorted((r.speaker, r.t0, r.t1) for r in back.collect()) == sorted((s, a * SECOND, b * SECOND) for _, s, a, b in REFERENCE)


def test_other_sources(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    caption = files.srt(spark, put("a.srt", "1\n00:00:01,500 --> 00:00:02,000\nann: hi: there\n\n2\n00:00:03,000 --> 00:00:04,000\nno speaker\n")).orderBy("t0").collect()
    assert [(c.speaker, c.text, c.t0) for c in caption] == [("ann", "hi: there", 1_500_000), ("", "no speaker", 3_000_000)]
    m = files.manifest(spark, put("m.csv", "s_01,a\\b.avi,20,1 2 3\nbad,row\ns_02,c,0,1\ns_03,d,5,x\n"), numbered=True).collect()
    assert [(r.tag, r.rel, r.frames, r.ids, r.line) for r in m] == [("s_01", "a/b.avi", 20, [1, 2, 3], 1)]
    assert [(r.token, r.id) for r in files.vocabulary(spark, put("v", "<unk> 1\na b 2\njunk\n")).orderBy("id").collect()] == [("<unk>", 1), ("a b", 2)]
    assert files.unit_list(files.vocabulary(spark, str(tmp_path / "v"))).count() == 4
    assert files.transcript(spark, put("t.txt", "Conf: 1\nTEXT:  HELLO YOU \n")).first().text == "HELLO YOU"
    assert sorted((r.suffix, r.stem) for r in files.stems(spark, put("st", "1\ta/b\nbare\n\n")).collect()) == [("01", "a/b"), ("??", "bare")]
    assert [r.sample_id for r in files.samples(spark, put("s.jsonl", '{"_meta": {"n": 1}}\n{"sample_id": "fs_000", "total_frames": 3}\n')).collect()] == ["fs_000"]
    assert [(r.speaker, r.t) for r in files.sightings(spark, put("x.csv", "a,1.5,c,d,e,f,g,h,01spk2\na,2,c,d,e,f,g,h,02spk2\nshort,1\n"), "01").collect()] == [("spk2", 1_500_000)]
    listed = files.files(spark, str(tmp_path), "*.t*")
    assert [r.stem for r in listed.collect()] == ["t"]


def test_text_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(X.timecode(F.lit(59_999_600), rounded=True)) == "00:01:00,000" and pick(X.timecode(F.lit(59_999_600))) == "00:00:59,999"
    assert pick(X.detokenise(F.lit("▁HEL LO▁YOU<eos>"))) == "HELLO YOU"
    assert pick(X.parent_id(F.lit("v_c_01"))) == "v" and X.shards("00-02,7") == ["00", "01", "02", "07"]
    assert pick(X.clip_parts(F.lit("v_c_01"))[1]) == "01" and pick(X.clip_parts(F.lit("v"))[0]) is None
    assert pick(X.wrap(F.lit("aa bb cccccc d"), 5)) == ["aa bb", "cccccc", "d"]
    assert pick(X.colour(F.lit(9), list("abcdefgh"), "z")) == "b" and pick(X.colour(F.lit(-1), ["a"], "z")) == "z"
    assert pick(arrays.resample(F.array(F.lit(0.0), F.lit(1.0)), 4)) == [0.0, 0.25, 0.75, 1.0]
    assert pick(arrays.chunk_starts(F.lit(10), 32, 4)) == [0]
    assert pick(arrays.exponential_average(F.array(F.lit(0.0), F.lit(1.0)), 0.5)) == 0.5
    state = F.create_map(F.lit("model.model.a"), F.lit(1), F.lit("ema.b"), F.lit(2))
    assert pick(arrays.rename_keys(state, ["model."], ["ema"])) == {"a": 1}
    mask = one.select(masks.span_mask(F.lit(3), F.lit(50), 0.4, 5).alias("x"))
    assert mask.first().x == mask.first().x and 0 < sum(mask.first().x) < 50
    box = lambda *x: [F.lit(float(v)) for v in x]
    assert pick(arrays.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7) and pick(arrays.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0


def test_state_machines():
    p = [0.1] * 3 + [0.9] * 10 + [0.1] * 6 + [0.9] * 2 + [0.1] * 6
    assert voice.speech(enumerate(p), voice.Hysteresis()) == [(2, 14)]
    whole = voice.Walker(voice.Hysteresis())
    halves, state, found = [p[:9], p[9:]], (-1, -1, -1), []
    for k, part in enumerate(halves):
        w = voice.Walker(voice.Hysteresis(), state)
        found += [s for i, x in enumerate(part) if (s := w.feed(9 * k + i, x))]
        state = w.state()
    assert found == [s for i, x in enumerate(p) if (s := whole.feed(i, x))] == [(3, 13)]
    assert list(voice.collector(((i, 5 <= i < 40) for i in range(80)))) == [(5, 50)]
    assert voice.speech([], voice.Hysteresis()) == [] and list(voice.collector([])) == []


def test_clusters_and_tracks(spark):
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert cluster.average_linkage(d, 0.5) == [0, 0, 1] and cluster.average_linkage(d, 0.86) == [0, 0, 0]
    boxes = [(f, f * 1.0, 0.0, f + 60.0, 60.0) for f in range(60)] + [(f, 500.0, 0.0, 560.0, 60.0) for f in range(0, 120, 2)]
    found = tracking.follow(boxes, tracking.Rules())
    assert sorted(len(t) for t in found) == [60, 60] and tracking.follow([], tracking.Rules()) == []
    kept = cluster.suppressed(spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0, 0.9), (1, 1.0, 0.0, 9.0, 9.0, 0.8), (1, 50.0, 0.0, 59.0, 9.0, 0.1)], "k int, x1 double, y1 double, x2 double, y2 double, s double"), ["k"], ["x1", "y1", "x2", "y2"], "s", 0.5, 10)
    assert sorted(r.s for r in kept.collect()) == [0.1, 0.9]
    edges = spark.createDataFrame([(1, 2, 3), (1, 3, 4), (1, 7, 8), (2, 3, 9)], "k int, a int, b int")
    assert sorted((r.k, r.node, r.component) for r in cluster.components(edges, ["k"]).collect()) == [(1, 2, 2), (1, 3, 2), (1, 4, 2), (1, 7, 7), (1, 8, 7), (2, 3, 3), (2, 9, 3)]


def test_search_and_tokens():
    table = np.log(np.array([[0.6, 0.3, 0.1], [0.2, 0.3, 0.5], [0.1, 0.1, 0.8]]))
    best = search.search(table, {"t": (1.0, search.Stateless(lambda _, i: table[i]))}, 3, 2, 3)
    assert best[0].labels == (0, 2) and best == sorted(best, key=lambda x: (-x.score, x.labels))
    from itertools import product

    def collapsed(path):
        out = [x for i, x in enumerate(path) if i == 0 or x != path[i - 1]]
        return [x for x in out if x]

    total = sum(np.exp(sum(table[t, x] for t, x in enumerate(p))) for p in product(range(3), repeat=3) if collapsed(p)[:2] == [1, 2])
    assert np.exp(search.prefix_score(table, [1, 2])) == pytest.approx(total)
    assert tokens.pieces("THEX", {"▁": 1, "▁THE": 2, "X": 3}, 4, 9) == [2, 3] and tokens.pieces("Q", {}, 1, 9) == [9, 9]


def test_batches(spark):
    d = spark.createDataFrame([("s", i, n) for i, n in enumerate([9, 9, 5, 5, 5, 2, 2, 1])], "s string, k int, n int")
    rows = batching.by_size(d, ["s"], "k", "n", 18, 3).collect()
    held: dict[int, list[int]] = {}
    for r in rows:
        held.setdefault(r.batch, []).append(r.n)
    assert sum(map(len, held.values())) == 8 and all(len(b) <= 3 and len(b) * max(b) <= 18 for b in held.values())
    made = batching.tuples(d, "k", "n", 5, 2, 12, 1).collect()
    assert all(len(set(t.members)) == 2 and t.total <= 12 for t in made) and [t.tuple for t in made] == sorted(t.tuple for t in made)
    c = spark.createDataFrame([("c", 0, "s", 0, 6, "a b cc dd ee"), ("c", 1, "s", 4, 9, "cc dd ee ff gg hh"), ("c", 2, "s", 20, 22, "cc dd ee")], "clip string, turn int, speaker string, t0 bigint, t1 bigint, text string")
    assert sorted(r.turn for r in captions.dedup(c, "clip", 0.4).collect()) == [1, 2]
