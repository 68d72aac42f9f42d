"""Span masks: what must hold of every draw, by sequence and by batch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.functions import masks
from timeloom.functions.masks import Spans


def runs_of(mask) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, int), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@pytest.mark.parametrize("kind", masks.KINDS)
def test_spans_apart(kind):
    """Spans laid apart have the lengths drawn and keep their distance, whatever is drawn."""
    for seed in range(200):
        rng = np.random.default_rng(seed)
        size, space = int(rng.integers(2, 120)), int(rng.integers(0, 5))
        lengths = masks.drawn_lengths(rng, size, Spans(0.7, 6, kind, other=1))
        laid = sorted(masks.laid_apart(rng, size, lengths, space))
        assert all(0 <= a and a + k <= size for a, k in laid)
        assert all(b - (a + k) >= space for (a, k), (b, _) in zip(laid, laid[1:], strict=False))
        left = sorted(lengths.tolist())
        for _, k in laid:
            left.remove(k)  # each is one of those drawn
        if sum(lengths) + space * len(lengths) <= size // 4:
            assert not [x for x in left if x]


def test_places_follow_free_length():
    """All places of a lone span are equally likely; a second one goes to the longer part more often."""
    starts = [masks.laid_apart(np.random.default_rng(s), 11, np.array([2]), 0)[0][0] for s in range(4000)]
    counts = np.bincount(starts, minlength=10)
    assert len(counts) == 10 and counts.min() > 300 and counts.max() < 500


def test_never_all_frames_and_counts():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        size = int(rng.integers(0, 30))
        found = masks.masked_frames(rng, size, Spans(5.0, 4, overlap=bool(seed % 2)))
        assert len(found) < max(1, size) and (found < size).all() and len(set(found.tolist())) == len(found)
    share = np.mean([len(masks.masked_frames(np.random.default_rng(s), 400, Spans(0.3, 10, overlap=False))) / 400 for s in range(200)])
    assert 0.27 < share < 0.33


def table(spark, n=60):
    rows = [(i, i // 8 if i < 40 else None, i % 50, 55, "x") for i in range(n)]
    return spark.createDataFrame(rows, "id int, batch int, size int, width int, rng string").repartition(5)


@pytest.mark.parametrize("equal", ["trim", "fill", None])
def test_batches_have_equal_counts(spark, equal):
    spans = Spans(0.4, 5, "poisson", least=1, overlap=False, space=2, equal=equal)
    found = masks.batch_masks(table(spark).where("size > 20"), "id", "size", spans, "batch", "width", seed=3).collect()
    own = {r.id: r for r in masks.batch_masks(table(spark).where("size > 20"), "id", "size", Spans(0.4, 5, "poisson", least=1, overlap=False, space=2), width="width", seed=3).collect()}
    counts: dict = {}
    for r in found:
        assert len(r["mask"]) == 55 and not any(r["mask"][r["size"] :]) and not all(r["mask"][: r["size"]])
        counts.setdefault(r.batch, []).append((sum(r["mask"]), sum(own[r.id]["mask"])))
        mine, drawn = np.array(r["mask"]), np.array(own[r.id]["mask"])
        if equal is None:
            assert (mine == drawn).all() and all(b - a >= 2 for (_, a), (b, _) in zip(runs_of(mine), runs_of(mine)[1:], strict=False))
        elif equal == "trim":
            assert not (mine & ~drawn).any()
        else:
            assert not (drawn & ~mine).any()
    pick = {"trim": min, "fill": max}.get(equal)
    for pairs in counts.values():
        if pick:
            assert {a for a, _ in pairs} == {pick(b for _, b in pairs)}


def test_draws_repeat_and_differ(spark):
    spans = Spans(0.5, 4, equal="trim", dropout=0.5)
    draw = lambda seed, epoch, parts: {r.id: r["mask"] for r in masks.batch_masks(table(spark).repartition(parts), "id", "size", spans, "batch", seed=seed, epoch=epoch).collect()}
    assert draw(1, 0, 2) == draw(1, 0, 7) != draw(1, 1, 2) and draw(1, 0, 2) != draw(2, 0, 2)
    whole = Spans(0.5, 4, equal="trim")
    kept = {r.id: r["mask"] for r in masks.batch_masks(table(spark), "id", "size", whole, "batch", seed=1).collect()}
    for i, mask in draw(1, 0, 2).items():
        assert sum(mask) == sum(kept[i]) - round(0.5 * sum(kept[i]))


def test_odd_rows(spark):
    rows = [(None, 1, None), (None, 1, None), (1, None, 0), (2, None, 1), (3, 1, -4), (4, 1, 2)]
    df = spark.createDataFrame(rows, "id int, batch int, size int")
    found = masks.batch_masks(df, "id", "size", Spans(0.9, 2, equal="fill"), "batch").collect()
    assert sorted(len(r["mask"]) for r in found) == [0, 0, 0, 0, 1, 2] and all(not all(r["mask"]) for r in found if r["mask"])
    assert masks.batch_masks(df.limit(0), "id", "size", Spans(equal="trim"), "batch").count() == 0
    with pytest.raises(ValueError, match="clash"):
        masks.batch_masks(df.withColumn("mask", F.lit(1)), "id", "size", Spans())
    with pytest.raises(ValueError, match="batches"):
        masks.batch_masks(df, "id", "size", Spans(equal="trim"))
    with pytest.raises(ValueError, match="kind"):
        Spans(kind="cauchy")
