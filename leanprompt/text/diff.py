"""Word diff by the longest common subsequence, and multiset differences of what must be preserved."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

MOST_CELLS = 2_000_000
# What a rewrite must preserve.
PRESERVED = {
    "numbers": re.compile(r"\d+(?:[.,]\d+)*"),
    "operators": re.compile(r"[=<>+*/^%]+"),
    "code": re.compile(r"```[\s\S]*?```|`[^`\n]+`"),
    "urls": re.compile(r"https?://\S+"),
    "quoted": re.compile(r'"[^"\n]+"'),
}


def word_diff(before: str, after: str) -> tuple[list[tuple[str, bool]], list[tuple[str, bool]]] | None:
    """(text, changed) of the words of both sides, each with the white space after it; None beyond MOST_CELLS cells.
    Where either side could go, the word of `before` is the changed one."""
    sides = [re.findall(r"\S+\s*", x) for x in (before, after)]
    a, b = ([w.rstrip() for w in side] for side in sides)
    if len(a) * len(b) > MOST_CELLS:
        return None
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    codes = {w: k for k, w in enumerate({*a, *b})}
    right = np.array([codes[w] for w in b], np.int64)
    for i in range(len(a) - 1, -1, -1):
        # a row is the greatest of the row below and of matches, taken over from the right
        match = np.where(right == codes[a[i]], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(match[::-1])[::-1]
    changed = ([True] * len(a), [True] * len(b))
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            changed[0][i] = changed[1][j] = False
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return list(zip(sides[0], changed[0])), list(zip(sides[1], changed[1]))


def losses(before: str, after: str) -> dict[str, list[str]]:
    """What occurs more often before than after, by kind, as often as it is missing."""
    out = {}
    for kind, p in PRESERVED.items():
        gone = Counter(p.findall(before)) - Counter(p.findall(after))
        if gone:
            out[kind] = sorted(gone.elements())
    return out
