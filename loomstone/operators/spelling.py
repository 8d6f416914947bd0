"""Optimal string alignment distance."""

from __future__ import annotations


def osa_distance(a: str, b: str) -> int:
    """Edits from a to b: insertion, deletion, substitution and swaps of neighbours, no part edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
    return row[-1]


def near_distance(a: str, b: str, limit: int) -> int:
    """osa_distance where it is at most limit, else limit + 1, in time that grows with the length alone: only places within
    limit of the diagonal are filled."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    far = limit + 1
    width = 2 * limit + 1
    two, before = [far] * width, [far] * width
    row = [k - limit if k >= limit else far for k in range(width)]  # row i holds the places j = i - limit, ..., i + limit
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [far] * width
        for k in range(width):
            j = i + k - limit
            if j < 0 or j > len(b):
                continue
            if j == 0:
                row[k] = min(i, far)
                continue
            cost = before[k] + (x != b[j - 1])
            if k + 1 < width:
                cost = min(cost, before[k + 1] + 1)
            if k:
                cost = min(cost, row[k - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, two[k] + 1)
            row[k] = min(cost, far)
        if min(row) >= far and min(before) >= far:
            return far
    return row[len(b) - len(a) + limit]
