"""Beam search with scorers that carry a state, against enumeration of all sequences."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from timeloom.operators import search

EOS, BLANK = 3, 0


def frames(seed: int, steps: int = 4, labels: int = 4) -> np.ndarray:
    raw = np.random.default_rng(seed).normal(size=(steps, labels))
    return raw - np.log(np.exp(raw).sum(1, keepdims=True))


def ctc_brute(table: np.ndarray, labels: tuple[int, ...], whole: bool) -> float:
    """Log-probability that all paths of frames read as the labels, or begin with them."""
    total = 0.0
    for path in product(range(table.shape[1]), repeat=len(table)):
        read = tuple(x for i, x in enumerate(path) if x != BLANK and (i == 0 or x != path[i - 1]))
        if read == labels if whole else read[: len(labels)] == labels:
            total += np.exp(sum(table[t, x] for t, x in enumerate(path)))
    return np.log(total) if total else -np.inf


def enumerate_all(table: np.ndarray, weights: dict[str, float], after: np.ndarray, steps: int) -> dict[tuple[int, ...], float]:
    """Joint scores of all finished sequences, by definition."""
    out = {}
    for n in range(steps + 1):
        for body in product([c for c in range(table.shape[1]) if c != EOS], repeat=n):
            if BLANK in body and weights.get("ctc"):
                continue
            q = (*body, EOS)
            scored = q[:steps]  # at the last step the end is added without a score
            score = weights["table"] * sum(table[i, c] for i, c in enumerate(scored))
            score += weights.get("ctc", 0) * ctc_brute(table, body, n < steps) if weights.get("ctc") else 0
            score += weights.get("bonus", 0) * len(scored)
            score += weights.get("after", 0) * sum(after[a, b] for a, b in zip((-1, *q), scored, strict=False))
            if score > -np.inf:
                out[q] = score
    return out


@pytest.mark.parametrize("weights", [{"table": 1.0}, {"table": 0.7, "ctc": 0.3}, {"table": 0.5, "ctc": 0.4, "bonus": 0.8}, {"table": 0.5, "after": 0.5, "bonus": -0.2, "ctc": 0.2}])
def test_a_wide_beam_finds_what_enumeration_finds(weights):
    after = frames(9, 5)
    for seed in range(3):
        table = frames(seed)
        scorers = {"table": (weights["table"], search.Table()), "ctc": (weights.get("ctc", 0), search.CtcPrefix(BLANK, EOS)), "bonus": (weights.get("bonus", 0), search.LengthBonus()), "after": (weights.get("after", 0), search.Transitions(after[-1], after[:-1]))}
        found = search.search(table, scorers, 400, EOS, patience=None)
        want = enumerate_all(table, weights, after, len(table))
        assert {f.labels: f.score for f in found} == pytest.approx(want)
        assert [f.labels for f in found[:5]] == sorted(want, key=lambda q: (-want[q], q))[:5]
        for f in found:
            assert f.score == pytest.approx(sum(scorers[n][0] * x for n, x in f.parts.items())) and set(f.parts) == {n for n, w in weights.items() if w}


def test_states_follow_kept_hypotheses():
    """With a narrow beam each kept sequence still has the score of its own history."""
    table = frames(5, 6, 6)
    scorers = {"table": (0.6, search.Table()), "ctc": (0.4, search.CtcPrefix(BLANK, EOS)), "bonus": (0.3, search.LengthBonus())}
    for f in search.search(table, scorers, 3, EOS, widen=2.0, patience=None):
        body = f.labels[:-1]
        n = min(len(f.labels), 6)
        assert f.parts["table"] == pytest.approx(sum(table[i, c] for i, c in enumerate(f.labels[:6])))
        assert f.parts["bonus"] == n and f.parts["ctc"] == pytest.approx(ctc_brute(table, body, len(f.labels) <= 6))


class Calls(search.Scorer):
    """Counts the labels it is asked for, and adds a final score."""

    partial = True
    asked = 0

    def score(self, state, labels):
        self.asked += labels.size
        return np.zeros(labels.shape), state

    def final(self, state, hyps):
        return np.full(hyps, 0.25)


def test_partial_scorers_see_chosen_labels_only():
    table = frames(2, 5, 50)
    calls = Calls()
    found = search.search(table, {"table": (1.0, search.Table()), "calls": (2.0, calls)}, 4, EOS, patience=None)
    assert 0 < calls.asked <= 5 * 4 * 6 and all(f.parts["calls"] == 0.25 for f in found)
    plain = search.search(table, {"table": (1.0, search.Table())}, 4, EOS, patience=None)
    assert [f.labels for f in found] == [f.labels for f in plain] and [f.score for f in found] == pytest.approx([f.score + 0.5 for f in plain])
    # chosen by another scorer: labels that it likes least are never scored
    likes = np.where(np.arange(50) < 6, 0.0, -9.0)
    by = search.search(table, {"table": (1.0, search.Table()), "likes": (0.001, search.Stateless(lambda q, i: likes)), "calls": (1.0, Calls())}, 4, EOS, chosen_by="likes", patience=None)
    assert all(c < 6 for f in by for c in f.labels)


def test_limits_of_search():
    table = frames(1, 6)
    scorers = lambda: {"table": (1.0, search.Table())}
    assert all(len(f.labels) > 3 for f in search.search(table, scorers(), 50, EOS, least=3, patience=None))
    assert max(len(f.labels) for f in search.search(table, scorers(), 50, EOS, steps=2, patience=None)) == 3
    assert max(len(f.labels) for f in search.search(table, scorers(), 50, EOS, slack=-1e-9, patience=1)) < max(len(f.labels) for f in search.search(table, scorers(), 50, EOS, patience=None))
    tied = search.search(np.zeros((2, 4)), scorers(), 3, EOS, patience=None)
    assert [f.labels for f in tied] == sorted(f.labels for f in tied)
    with pytest.raises(ValueError, match="weight"):
        search.search(table, {"table": (0.0, search.Table())}, 3, EOS)
    with pytest.raises(ValueError, match="full scorer"):
        search.search(table, scorers(), 3, EOS, chosen_by="ctc")


def test_decode_tables(spark):
    kind = "clip string, step int, scores array<double>, key string, rank int"
    rows = [("a", 1, [-1.0, -2.0, None, -0.5], "x", 1), ("a", 0, [-0.1, -2.0, -3.0, -4.0], "x", 1), ("a", None, [0.0], "x", 1), ("b", 0, None, "x", 1), (None, 0, [-1.0, float("nan")], "x", 1), (None, 0, [-1.0], "x", 1), ("c", 0, [], "x", 1)]
    found = search.beam(spark.createDataFrame(rows, kind), "clip", "step", "scores", beam=2, eos=3).collect()
    assert {r.clip for r in found} == {"a", None}
    assert [(list(r.ids), r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.clip == "a"] == [([0, 3], pytest.approx(-0.6)), ([0, 0, 3], pytest.approx(-1.1))]
    assert search.beam(spark.createDataFrame([], kind), "clip", "step", "scores", beam=2, eos=3).count() == 0


def test_a_table_without_any_possible_sequence(spark):
    """A narrow beam that is left with impossible prefixes finds nothing: no rows, and other keys keep theirs."""
    # three frames that all like 1 best: 1 1 needs a blank between, and labels beyond the beam are never asked
    rows = [("none", i, [-9.0, -0.001, -8.0, -20.0]) for i in range(3)] + [("some", i, [-0.7, -0.8, -3.0, -0.9]) for i in range(3)]
    scorers = lambda: {"table": (1.0, search.Table()), "ctc": (1.0, search.CtcPrefix(BLANK, EOS))}
    table = np.array([x for *_, x in rows[:3]])
    assert search.search(table, scorers(), 1, EOS, widen=1.0) == []
    df = spark.createDataFrame(rows, "clip string, step int, scores array<double>")
    found = search.decode(df, "clip", "step", "scores", scorers, beam=1, eos=EOS, widen=3.0).collect()
    assert "some" in {r.clip for r in found}
    assert search.decode(df.where("clip = 'none'"), "clip", "step", "scores", scorers, beam=1, eos=EOS, widen=1.0).collect() == []
