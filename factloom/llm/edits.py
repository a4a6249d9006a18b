"""Edit distances with transpositions, shared by the name and lookup operators."""

from __future__ import annotations


def edits(a: str, b: str, most: int) -> list[tuple[str, int]] | None:
    """A shortest list of edits from a to b, as (kind, place in a); None if more than ``most`` are needed.

    Kinds: sub, ins, del, swap (of neighbours).
    """
    if a == b:
        return []
    if abs(len(a) - len(b)) > most:
        return None
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    n, m = len(x), len(y)
    if n == 0:
        return [("ins", lo)] * m if m <= most else None
    if m == 0:
        return [("del", lo + k) for k in range(n)] if n <= most else None
    d = [list(range(m + 1))] + [[k + 1] + [0] * m for k in range(n)]
    for i in range(1, n + 1):
        row, above, c = d[i], d[i - 1], x[i - 1]
        for j in range(1, m + 1):
            best = above[j - 1] + (c != y[j - 1])
            if above[j] + 1 < best:
                best = above[j] + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == y[j - 1] and d[i - 2][j - 2] + 1 < best:
                best = d[i - 2][j - 2] + 1
            row[j] = best
        if min(row) > most and min(above) > most:
            return None
    if d[n][m] > most:
        return None
    out: list[tuple[str, int]] = []
    i, j = n, m
    while i or j:
        here = d[i][j]
        if i and j and x[i - 1] == y[j - 1] and d[i - 1][j - 1] == here:
            i, j = i - 1, j - 1
        elif i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1] and d[i - 2][j - 2] + 1 == here:
            out.append(("swap", lo + i - 2))
            i, j = i - 2, j - 2
        elif i and j and d[i - 1][j - 1] + 1 == here:
            out.append(("sub", lo + i - 1))
            i, j = i - 1, j - 1
        elif i and d[i - 1][j] + 1 == here:
            out.append(("del", lo + i - 1))
            i -= 1
        else:
            out.append(("ins", lo + i))
            j -= 1
    return out[::-1]


def distance(a: str, b: str, most: int) -> int | None:
    """Damerau-Levenshtein distance (neighbours swapped count 1), or None beyond ``most``."""
    found = edits(a, b, most)
    return None if found is None else len(found)
