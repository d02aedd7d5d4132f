"""Alignment of two sequences of line hashes."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, given by rising first place, whose second place rises too."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b), ends.append(n)
        else:
            tops[at], ends[at] = b, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _anchors(a: Sequence[int], b: Sequence[int], span: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Pairs of equal lines inside a span that align it: the rarest as often in both, in their order.

    Without such lines the first of the rarest common one are paired.
    """
    i, j, k, m = span
    here, there = Counter(a[i:j]), Counter(b[k:m])
    common = {x: max(n, there[x]) for x, n in here.items() if x in there}
    if not common:
        return []
    even = [x for x in common if here[x] == there[x]]
    if even:
        least = min(common[x] for x in even)
        chosen = {x for x in even if common[x] == least}
    else:
        chosen = {min(common, key=lambda x: (common[x], x))}
    places = defaultdict(list)
    for p in range(k, m):
        if b[p] in chosen:
            places[b[p]].append(p)
    used: Counter = Counter()
    pairs = []
    for p in range(i, j):
        x = a[p]
        if x in chosen and used[x] < len(places[x]):
            pairs.append((p, places[x][used[x]]))
            used[x] += 1
    return _rising(pairs)


def align(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Blocks (i, j, k, m) in order: a[i:j] became b[k:m]; all between them is equal."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
        if i == j and k == m:
            continue
        pairs = _anchors(a, b, (i, j, k, m)) if i < j and k < m else []
        if not pairs:
            out.append((i, j, k, m))
            continue
        edges = [(i - 1, k - 1), *pairs, (j, m)]
        stack += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])][::-1]
    # a stretch of one side only may follow another without an equal line between
    joined: list[tuple[int, int, int, int]] = []
    for block in out:
        if joined and joined[-1][1] == block[0] and joined[-1][3] == block[2]:
            block = (joined[-1][0], block[1], joined[-1][2], block[3])
            joined.pop()
        joined.append(block)
    return joined


def blocks(a: Column, b: Column) -> Column:
    """``align`` of two arrays of hashes, as one array of four whole numbers a block."""

    @F.pandas_udf("array<int>")
    def aligned(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[n for block in align(p.tolist(), q.tolist()) for n in block] for p, q in zip(x, y)])

    return aligned(a, b)
