"""Beam search over score tables by scorers that carry a state, and prefix scores; no model is part of this.

All hypotheses of a step are scored together: states are arrays whose first axis is the hypotheses.  Full scorers score every label; the
best labels by their sum go on to the partial scorers, whose work a label is larger.  The states of the hypotheses that
are kept, and only theirs, are extended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays with one entry (or row) a hypothesis, by name.
State = dict[str, np.ndarray]
NEVER = -np.inf


class Scorer:
    """Log-scores of the labels that may follow.

    ``begin`` makes the state of the empty hypothesis from a table (steps x labels).  ``score`` takes a state of h hypotheses
    and h x c labels, and returns as many scores and whatever ``keep`` needs.  ``keep`` returns the state of the hypotheses that
    go on: number i extends hypothesis ``hyps[i]`` by its ``columns[i]``-th label, which is ``labels[i]``.  ``final`` is added
    to hypotheses that end.
    """

    #: Whether only labels chosen by the other scorers are scored.
    partial = False

    def begin(self, table: np.ndarray) -> State:
        return {}

    def score(self, state: State, labels: np.ndarray) -> tuple[np.ndarray, State]:
        raise NotImplementedError

    def keep(self, grown: State, hyps: np.ndarray, columns: np.ndarray, labels: np.ndarray) -> State:
        return {name: values[hyps] for name, values in grown.items()}

    def final(self, state: State, hyps: int) -> np.ndarray:
        return np.zeros(hyps)


class Table(Scorer):
    """The table's own scores, one step a label; nothing can follow its last step."""

    def begin(self, table: np.ndarray) -> State:
        self.table = table
        return {"step": np.zeros(1, np.int64)}

    def score(self, state: State, labels: np.ndarray) -> tuple[np.ndarray, State]:
        step = state["step"]
        there = step < len(self.table)
        out = np.full(labels.shape, NEVER)
        out[there] = np.take_along_axis(self.table[step[there]], labels[there], axis=1)
        return out, {"step": step + 1}


class Transitions(Scorer):
    """Scores of each label after the last one: ``first`` for the first label, then rows of ``after``."""

    def __init__(self, first: np.ndarray, after: np.ndarray) -> None:
        self.rows = np.concatenate([after, first[None]])

    def begin(self, table: np.ndarray) -> State:
        return {"last": np.full(1, -1, np.int64)}

    def score(self, state: State, labels: np.ndarray) -> tuple[np.ndarray, State]:
        return np.take_along_axis(self.rows[state["last"]], labels, axis=1), state

    def keep(self, grown: State, hyps: np.ndarray, columns: np.ndarray, labels: np.ndarray) -> State:
        return {"last": labels}


class LengthBonus(Scorer):
    """One for every label."""

    def score(self, state: State, labels: np.ndarray) -> tuple[np.ndarray, State]:
        return np.ones(labels.shape), state


class Stateless(Scorer):
    """A function of the labels so far and of the step, which returns the scores of all labels."""

    def __init__(self, function: Callable[[tuple[int, ...], int], np.ndarray]) -> None:
        self.function = function

    def begin(self, table: np.ndarray) -> State:
        return {"labels": np.zeros((1, 0), np.int64)}

    def score(self, state: State, labels: np.ndarray) -> tuple[np.ndarray, State]:
        rows = np.stack([self.function(tuple(x), len(x)) for x in state["labels"].tolist()])
        return np.take_along_axis(rows, labels, axis=1), state

    def keep(self, grown: State, hyps: np.ndarray, columns: np.ndarray, labels: np.ndarray) -> State:
        return {"labels": np.concatenate([grown["labels"][hyps], labels[:, None]], axis=1)}


class CtcPrefix(Scorer):
    """How much each label lowers the log-probability that frames, read without blanks and repeats, begin with the hypothesis.

    The state holds, for each number of frames, how likely they read as the hypothesis with its last label at the end, and with a
    blank there.  So a label costs one pass over the frames, whatever the hypothesis' length.  ``eos`` stands for that
    nothing follows; the blank itself never follows.
    """

    partial = True

    def __init__(self, blank: int, eos: int) -> None:
        self.blank, self.eos = blank, eos

    def begin(self, table: np.ndarray) -> State:
        self.table = table
        label = np.full((1, len(table) + 1), NEVER)
        blank = np.concatenate([[0.0], np.cumsum(table[:, self.blank])])[None]
        return {"label": label, "blank": blank, "prefix": np.zeros(1), "last": np.full(1, -1, np.int64)}

    def score(self, state: State, labels: np.ndarray) -> tuple[np.ndarray, State]:
        n = len(self.table)
        both = np.logaddexp(state["label"], state["blank"])
        repeats = labels == state["last"][:, None]
        label, blank = (np.full((*labels.shape, n + 1), NEVER) for _ in range(2))
        prefix = np.full(labels.shape, NEVER)
        for t in range(n):
            here = self.table[t][labels]
            before = np.where(repeats, state["blank"][:, t, None], both[:, t, None])
            label[..., t + 1] = np.logaddexp(label[..., t], before) + here
            blank[..., t + 1] = np.logaddexp(label[..., t], blank[..., t]) + self.table[t, self.blank]
            prefix = np.logaddexp(prefix, before + here)
        prefix = np.where(labels == self.eos, both[:, -1, None], prefix)
        prefix[labels == self.blank] = NEVER
        known = state["prefix"][:, None]
        gain = np.where(prefix > NEVER, prefix - np.where(known > NEVER, known, 0), NEVER)
        return gain, {"label": label, "blank": blank, "prefix": prefix}

    def keep(self, grown: State, hyps: np.ndarray, columns: np.ndarray, labels: np.ndarray) -> State:
        return {name: values[hyps, columns] for name, values in grown.items()} | {"last": labels}


@dataclass(frozen=True)
class Found:
    """A finished sequence, its score, and what each scorer gave (without weights)."""

    labels: tuple[int, ...]
    score: float
    parts: dict[str, float]


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` best scores of each row, ties to the smaller column, in ascending order."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.sort(order, axis=1)


def search(table: np.ndarray, scorers: dict[str, tuple[float, Scorer]], beam: int, eos: int, steps: int | None = None, least: int = 0, widen: float = 1.5, chosen_by: str | None = None, patience: int | None = 3, slack: float = -10.0) -> list[Found]:
    """The best finished sequences, best first, ties to the smaller labels.

    ``scorers`` are weights and scorers by name; those of weight 0 are skipped.  Partial ones score the ``widen * beam`` labels
    that are best by the weighted sum of the full ones, or by the one named ``chosen_by``; without full scorers they score
    all labels.  Sequences end at ``eos`` (those of ``least`` labels or fewer, without it, are dropped) or after ``steps`` labels (as many as
    the table has steps), where ``eos`` is added without a score.  Search ends early when the best sequences of the
    last ``patience`` lengths all lie more than ``-slack`` under the best of all; ``None`` never ends early.  What has a score of minus infinity
    is no hypothesis.
    """
    active = {name: (w, s) for name, (w, s) in scorers.items() if w}
    full = {n: x for n, x in active.items() if not x[1].partial}
    part = {n: x for n, x in active.items() if x[1].partial}
    if not active:
        raise ValueError("no scorer has a weight")
    if chosen_by is not None and chosen_by not in full:
        raise ValueError(f"{chosen_by} is no full scorer with a weight")
    steps, vocabulary = len(table) if steps is None else steps, table.shape[1]
    states = {name: s.begin(table) for name, (_, s) in active.items()}
    totals, sequences = np.zeros(1), np.zeros((1, 0), np.int64)
    sums = {name: np.zeros(1) for name in active}
    ended: list[Found] = []

    def finish(which: np.ndarray, labels: np.ndarray) -> None:
        n = len(totals)
        finals = {name: s.final(states[name], n) for name, (_, s) in active.items()}
        for i, row in zip(which.tolist(), labels.tolist(), strict=True):
            parts = {name: float(sums[name][i] + finals[name][i]) for name in active}
            ended.append(Found(tuple(row), float(totals[i] + sum(w * finals[name][i] for name, (w, _) in active.items())), parts))

    for step in range(steps):
        n = len(totals)
        every = np.broadcast_to(np.arange(vocabulary), (n, vocabulary))
        own, grown = {}, {}
        for name, (_, s) in full.items():
            own[name], grown[name] = s.score(states[name], every)
        weighted = sum((w * own[name] for name, (w, _) in full.items()), np.zeros((n, vocabulary)))
        labels = every
        if part and full:
            labels = top(weighted if chosen_by is None else own[chosen_by], max(1, int(widen * beam)))
            own = {name: np.take_along_axis(x, labels, axis=1) for name, x in own.items()}
            weighted = np.take_along_axis(weighted, labels, axis=1)
        for name, (w, s) in part.items():
            own[name], grown[name] = s.score(states[name], labels)
            weighted = weighted + w * own[name]
        weighted = totals[:, None] + weighted
        # hypotheses are in the order of their labels, so ties go to the smaller sequence
        flat = np.argsort(-weighted, axis=None, kind="stable")[:beam]
        flat = np.sort(flat[weighted.ravel()[flat] > NEVER])
        hyps, columns = np.divmod(flat, labels.shape[1])
        chosen = labels[hyps, columns]
        states = {name: s.keep(grown[name], hyps, columns, chosen) for name, (_, s) in active.items()}
        sums = {name: sums[name][hyps] + own[name][hyps, columns] for name in active}
        totals, sequences = weighted[hyps, columns], np.concatenate([sequences[hyps], chosen[:, None]], axis=1)
        over = np.flatnonzero(chosen == eos)
        if step >= least:
            finish(over, sequences[over])
        on = np.flatnonzero(chosen != eos)
        states = {name: {k: v[on] for k, v in state.items()} for name, state in states.items()}
        totals, sequences, sums = totals[on], sequences[on], {name: x[on] for name, x in sums.items()}
        if not len(on):
            break
        if patience is not None and ended:
            best = max(f.score for f in ended)
            by_length = [max((f.score for f in ended if len(f.labels) == step + 1 - i), default=None) for i in range(patience)]
            if all(x is not None and x - best < slack for x in by_length):
                break
    finish(np.arange(len(totals)), np.concatenate([sequences, np.full((len(totals), 1), eos)], axis=1))
    return sorted(ended, key=lambda f: (-f.score, f.labels))


def table_of(pdf: pd.DataFrame, step: str, scores: str) -> np.ndarray:
    """Steps x labels, in the order of the steps; scores that are missing, null or no number can never be chosen."""
    rows = pdf.sort_values(step, kind="stable")[scores].to_list()
    out = np.full((len(rows), max(len(r) for r in rows)), NEVER)
    for to, row in zip(out, rows, strict=True):
        values = np.array([np.nan if x is None else x for x in row], float)
        to[: len(row)] = np.where(np.isnan(values), NEVER, values)
    return out


def decode(df: DataFrame, key: str, step: str, scores: str, scorers: Callable[[], dict[str, tuple[float, Scorer]]], beam: int, eos: int, **options) -> DataFrame:
    """``key, rank, ids, score, parts`` of the ``beam`` best sequences of each key's score table, by all ``scorers`` together.

    ``scorers`` makes them anew for each key; ``options`` are those of :func:`search`.  ``parts`` maps each scorer's name to its share,
    without its weight.  Rows whose scores or step are null are left out; shorter rows of scores end in labels that are never chosen;
    rows that repeat a step follow each other.  A null key is a key.  A key's table must fit a task.  An empty table gives no rows, nor does one
    in which the beam is left with impossible sequences before any ended.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = search(table_of(pdf, "step", "scores"), scorers(), beam, eos, **options)[:beam]
        # of objects, as pandas takes empty columns for numbers and Arrow makes no lists of those
        return pd.DataFrame({"key": [pdf["key"].iloc[0]] * len(found), "rank": range(1, len(found) + 1), "ids": [list(f.labels) for f in found], "score": [f.score for f in found], "parts": [f.parts for f in found]}, dtype=object)

    rows = df.select(df[key].alias("key"), df[step].alias("step"), df[scores].alias("scores")).where("scores IS NOT NULL AND step IS NOT NULL AND size(scores) > 0")
    found = rows.groupBy("key").applyInPandas(run, f"key {df.schema[key].dataType.simpleString()}, rank int, ids array<int>, score double, parts map<string, double>")
    return found.withColumnRenamed("key", key)


def beam(df: DataFrame, key: str, step: str, scores: str, beam: int, eos: int, **options) -> DataFrame:
    """``key, rank, ids, score`` of the best sequences by the table's own scores; see :func:`decode`."""
    return decode(df, key, step, scores, lambda: {"table": (1.0, Table())}, beam, eos, **options).drop("parts")


def prefix_score(table: np.ndarray, labels: Sequence[int], blank: int = 0) -> float:
    """Log-probability that a frame table's collapsed labels begin with ``labels``."""
    scorer, total = CtcPrefix(blank, -1), 0.0
    state = scorer.begin(table)
    for c in labels:
        _, grown = scorer.score(state, np.array([[c]]))
        state = scorer.keep(grown, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([c]))
        total = float(state["prefix"][0])
    return total


def ctc(df: DataFrame, key: str, step: str, scores: str, labels: Sequence[int], blank: int = 0) -> DataFrame:
    """``key, score``: :func:`prefix_score` of each key's table; rows without scores are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "score": [prefix_score(table_of(pdf, step, scores), labels, blank)]})

    return df.where(F.col(scores).isNotNull()).groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, score double")
