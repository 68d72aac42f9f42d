"""The pipeline on a small corpus, stage by stage."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from timeloom.llm import ngram_join

WORDS = {"en": ["the", "with", "tion", "whale", "shore"], "de": ["sch", "ung", "keit", "für", "pfad"]}


def corpus(spark, folder):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        lines = [" ".join("".join(rng.choices(WORDS[lang], k=2)) + str(rng.randrange(90)) for _ in range(12)) for _ in range(5)]
        rows.append((i, "\n".join(lines), lang, f"src{i % 3}"))
    rows.append((500, rows[4][1], "en", "src1"))
    rows.append((501, rows[6][1].replace("\n", " ") + " end", "en", "src1"))
    rows.append((502, rows[6][1].replace("\n", " "), "en", "src1"))
    rows += [(503, "42 !!", "en", "src1"), (504, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    d.write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean = set(range(120))
    assert [clean <= s for s in sizes] == [True] * 4
    assert not {503, 504} & sizes[0] and 500 not in sizes[1] and {501, 502} <= sizes[1]
    assert {6, 501, 502} & sizes[2] == {6}  # the words are the same, only line feeds differ
    direct = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in direct.select("doc_id").collect()} == sizes[3]
    assert len(rows) == 125 and ngram_join.Similarity().num == 90


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_under_the_bar_of_op8(spark):
    """A pair of 5-word Jaccard 0.8 or more whose 3-word Jaccard is under 0.9; and one under both bars."""
    words = [f"w{i}" for i in range(200)]
    near, far = list(words), list(words)
    for at in (30, 80, 130, 180):
        near[at] = "changed"
    for at in range(10, 200, 20):
        far[at] = f"other{at}"

    def jaccard(a, b, n):
        x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a, b))
        return len(x & y) / len(x | y)

    assert jaccard(words, near, 5) >= 0.8 and jaccard(words, near, 3) < 0.9 and jaccard(words, far, 5) < 0.8
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(near), "en", "s", 0), (3, " ".join(far), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {1, 3}


def test_near_copies_by_row(spark):
    """Rows that share an id, or have none, are judged each for itself."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    texts = [(9, a), (2, a + " end"), (9, b), (5, c), (5, c), (None, d), (None, d), (None, b + " end")]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = sorted((r.text, r.doc_id) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert found == [(a + " end", 2), (b, 9), (c, 5), (d, None)]


def test_signatures_stay_few_at_the_bar_of_the_pipeline():
    elements = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 1000).astype(np.uint64))
    _, found = ngram_join.signatures(elements, np.array([0, 1000]), corpus_pipeline.NEAR)
    assert len(found) < 5000


def test_similar_sets_share_a_signature_at_the_bar_of_the_pipeline():
    """Where groups are thin, empty signatures count by threes; no similar pair may be lost, at any size."""
    rng = np.random.default_rng(3)
    like = corpus_pipeline.NEAR
    for n in (6, 15, 40, 90, 200, 600, 2500, 9000):
        for _ in range(25 if n < 1000 else 6):
            a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            apart = int(rng.integers(0, like.differ(2 * n) + 1))
            gone = int(rng.integers(0, apart + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(1, 1 << 62, apart - gone).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)) or np.array_equal(a, b):
                continue
            owner, found = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), like)
            assert set(found[owner == 0].tolist()) & set(found[owner == 1].tolist())


def test_the_corpus_part_is_there():
    """The entry leaves the part out where it cannot be imported; while its folder stands here, it must not."""
    import re

    import __spark_entry__

    found = {m[1] for name in __spark_entry__.queries() if (m := re.match(r"op(\d+)_", name))}
    assert found == {str(n) for n in range(1, 14)} and "pipeline" in __spark_entry__.queries()
