"""Optimal one-to-one assignment on small matrices."""

from __future__ import annotations

import numpy as np


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the one-to-one assignment with the largest total gain.

    Shortest augmenting paths over reduced costs; rows and columns may differ in number.
    Pairs without gain are left out.
    """
    gain = np.asarray(gain, float)
    if not gain.size:
        return []
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for start in range(n):
        distance = np.full(m, np.inf)
        came = np.full(m, -1)
        done = np.zeros(m, bool)
        row, reached, column = start, 0.0, -1
        while True:
            step = reached + cost[row] - row_price[row] - col_price
            better = ~done & (step < distance)
            distance[better] = step[better]
            came[better] = column
            column = int(np.where(done, np.inf, distance).argmin())
            reached = distance[column]
            done[column] = True
            if holder[column] < 0:
                break
            row = holder[column]
        for j in np.flatnonzero(done):
            slack = reached - distance[j]
            col_price[j] -= slack
            if holder[j] >= 0:
                row_price[holder[j]] += slack
        row_price[start] += reached
        while column >= 0:
            previous = came[column]
            holder[column] = start if previous < 0 else holder[previous]
            column = previous
    pairs = [(int(r), c) for c, r in enumerate(holder) if r >= 0]
    pairs = [(c, r) if turned else (r, c) for r, c in pairs]
    return sorted((r, c) for r, c in pairs if gain[r, c] > 0)
