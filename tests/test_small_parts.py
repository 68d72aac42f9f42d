"""Parts without a query of their own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.catalog import oracle_sql, queries
from timeloom.functions import arrays
from timeloom.operators import batching, cluster
from timeloom.sources import files, sinks


def test_every_nth_and_chunks(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(20)], "i int, k int").repartition(4)
    assert sorted(r.i for r in files.every_nth(rows, "i", 6).collect()) == [0, 6, 12, 18]
    assert sorted(r.i for r in files.every_nth(rows, "i", 6, last=2).collect()) == [12, 18]
    assert files.every_nth(rows.limit(0), "i", 6).count() == 0
    found = {r.i: r.c for r in sinks.chunked(rows, ["k", "i"], 7, "c").collect()}
    order = sorted(range(20), key=lambda i: (i % 3, i))
    assert found == {i: n // 7 for n, i in enumerate(order)}


def test_split_lists(spark, tmp_path):
    (tmp_path / "split.txt").write_text(" a_c_01 \n\n\tb\n")
    assert sorted(r.clip for r in files.split_list(spark, str(tmp_path / "split.txt")).collect()) == ["a_c_01", "b"]


def test_vectors_of_odd_shapes(spark):
    kind = "clip string, i int, v array<double>, vs array<array<double>>, frames array<int>"
    vectors = [[1.0, 0.0, 0.0], [1.0], [0.0, 1.0, None], [float("nan"), 1.0], None, []]
    rows = [(c, i, v, [v] if v else None, None) for c in ("a", None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, kind)
    found = {(r.clip, r.i): r.cluster for r in cluster.linked(df, ["clip"], "i", "v", 0.5).collect()}
    assert found == {(c, i): n for c in ("a", None) for i, n in enumerate([0, 0, 1, 1])} | {(c, 5): 2 for c in ("a", None)}
    same = {(r.clip, r.i): r.identity for r in cluster.identities(df, ["clip"], "i", "vs", "frames", 0.5).collect()}
    assert same == {(c, i): n for c in ("a", None) for i, n in enumerate([0, 0, 1, 1])}
    assert cluster.linked(df.limit(0), ["clip"], "i", "v", 0.5).count() == 0


def test_random_orders_repeat(spark):
    rows = spark.createDataFrame([(i, i // 5) for i in range(40)], "i int, n int")
    place = lambda seed, epoch, parts: [r.i for r in rows.repartition(parts).orderBy(*batching.keyed_order(rows.n, rows.i, seed, epoch)).collect()]
    first = place(1, 0, 2)
    assert first == place(1, 0, 5) != place(2, 0, 2) and first != place(1, 1, 2)
    assert [i // 5 for i in first] == sorted((i // 5 for i in range(40)), reverse=True) and sorted(first) == list(range(40))




def test_array_files_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.5, 2.0, "x"), ("a", 0, 0.0, 1.5, None), ("b", 7, 0.25, 9.0, 'q"')], "clip string, track_idx int, start double, end double, speaker string")
    sinks.write_json_arrays(rows, str(tmp_path / "s"), ["clip"], ["track_idx"], ["track_idx", "start", "end", "speaker"])
    found = {c: sorted((r.track_idx, r.t0, r.t1, r.speaker) for r in files.segment_tracks(spark, str(tmp_path / "s" / f"clip={c}")).collect()) for c in "ab"}
    assert found == {"a": [(0, 0, 1_500_000, None), (1, 1_500_000, 2_000_000, "x")], "b": [(7, 250_000, 9_000_000, 'q"')]}


def test_rounding_keeps_the_sign_of_zero(spark):
    """As the SQL side does: what rounds to zero from below is -0.0."""
    rows = spark.createDataFrame([(0, -1e-7), (1, 1e-7), (2, -0.0), (3, 0.1234565), (4, None), (5, -0.5)], "i int, x double").select("i", arrays.rounded(F.col("x"), 6).alias("r"))
    assert {r.i: str(r.r) for r in rows.collect()} == {0: "-0.0", 1: "0.0", 2: "-0.0", 3: "0.123457", 4: "None", 5: "-0.5"}


def test_cut_or_pad_keeps_the_sign_of_zero(spark, tmp_path):
    spark.createDataFrame([(0, [-1e-7, 0.25])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = queries()["cut_or_pad"](spark, str(tmp_path)).first().v
    assert len(v) == 56 and [str(x) for x in v[:3]] == ["-0.0", "0.25", "0.0"]


def test_words_as_the_sql_has_them(spark, tmp_path):
    """Null references are not scored, a vertical tab parts no words, and upper case has as many characters."""
    duckdb = pytest.importorskip("duckdb")
    texts = [(1, 0, None), (1, 1, "a b"), (1, 2, None), (2, 0, "Straße x\x0by \ufb01n"), (2, 1, "STRASSE x y FIN"), (2, 2, "straße"), (2, 3, ""), (2, 4, "\u1fb3 c")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in texts], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("wer_pairs", "wer_corpus"):
        want = sorted(con.execute(oracle_sql()[name]).fetchall())
        assert sorted(tuple(r) for r in queries()[name](spark, str(tmp_path)).collect()) == want


def test_similar_pairs_by_blocks(spark, monkeypatch):
    """Blocks of a few vectors find what all pairs find, and no join makes the pairs."""
    monkeypatch.setattr(cluster, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    odd = [(60, 0, None), (61, 0, [1.0, None, 0.0, 0.0]), (62, 0, [0.0] * 4), (63, 0, [1.0]), (64, 0, [2.0]), (65, None, [1.0] * 4), (None, 0, [1.0] * 4)]
    found = cluster.similar(spark.createDataFrame(rows + odd, "i long, k int, v array<double>"), "k", "i", "v", 0.4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    want = {(i, j): cos(x, y) for i, k, x in rows for j, m, y in rows if k == m and i < j and cos(x, y) >= 0.4} | {(63, 64): 1.0}
    got = [(r.a, r.b, r.cosine) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): c for a, b, c in got} == pytest.approx(want)
