"""Registered queries work on whole texts and whole tables."""

from __future__ import annotations

import random

import __spark_entry__

TURNS = 4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def wrap(text, width):
    lines = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return "\n".join(lines)


def test_texts_are_whole(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices(["the", "of", "whale", "shore", "harpooneer", "sea"], k=60))
    texts = {(c, t): text() for c in range(3) for t in range(TURNS)}
    rows = [(c, t, "user", x) for (c, t), x in texts.items()]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, texts[0, 0], "en")], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    errors = {(c, t): distance(x.split(), texts.get((c, t + 1), "").split()) for (c, t), x in texts.items()}
    assert {(r.clip, r.turn): r.errors for r in run("wer_pairs")} == errors
    (total,) = run("wer_corpus")
    assert (total.errors, total.words) == (sum(errors.values()), 60 * len(texts))
    assert {(r.clip, r.turn): r.errors for r in run("cer_pairs")} == {(c, t): distance(x, texts.get((c, t + 1), "")) for (c, t), x in texts.items()}
    assert {(r.conv_id, r.turn): r.text for r in run("wrapped")} == {k: wrap(x, 30) for k, x in texts.items()}
    (ids,) = run("tokenize_words")
    assert list(ids.ids) == [{"the": 2, "of": 3}.get(w, 1) for w in texts[0, 0].split()] and ids.n == 60


def test_all_clips_and_faces(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(22 * 20)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = [(1, 7, "click", "2024-01-01 10:00:00", 10.0), (2, 7, "view", "2024-01-01 10:01:40", 10.0), (3, 10, "error", "2024-01-01 12:00:00", 10.0)]
    events = spark.createDataFrame(seen, "event_id bigint, user_id bigint, event_type string, ts string, value double")
    events.selectExpr("event_id", "user_id", "event_type", "cast(ts AS timestamp) AS ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert {r.clip for r in run("beam_search")} == {r.clip for r in run("ctc_score")} == set(range(22))
    # only the face of user 7 lasts, from the first to the second event
    split = {r.event_id: (r.shared, r.on_screen) for r in run("onscreen_split")}
    assert split == {1: (10_000_000, True), 2: (0, False), 3: (0, False)}
    assert {r.clip: (r.on_us, r.off_us) for r in run("onscreen_summary")} == {x: (10_000_000, 20_000_000) for x in ("all", "2024-01-01")}
    assert [r.speakers for r in run("never_on_screen")] == ["error,view"]
