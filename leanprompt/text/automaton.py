"""Patterns over batches of texts by an automaton (RE2, through Arrow), whose time is linear in the text whatever the pattern.

It tells which texts cannot hold a match, so that the exact pattern, which backtracks, runs on the others alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc

SLICE_TEXTS, SLICE_CHARS = 256, 4_000_000


def slices(texts: Sequence[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most SLICE_TEXTS texts and, but for one long text, SLICE_CHARS characters."""
    part, chars = [], 0
    for t in texts:
        if part and (len(part) == SLICE_TEXTS or chars + len(t or "") > SLICE_CHARS):
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t or "")
    if part:
        yield part


@lru_cache(maxsize=1024)
def loosened(pattern: re.Pattern) -> str | None:
    """A pattern of the automaton's that matches wherever this one does (and perhaps elsewhere): assertions on what lies
    around are left out. None if there is none, as for back references."""
    source, out, k, inside = pattern.pattern, [], 0, None
    while k < len(source):
        c = source[k]
        if c == "\\":
            pair = source[k : k + 2]
            if pair[1].isdigit():
                return None
            space = r"\s\x0b" if inside == "[" else r"\s" if inside else r"[\s\x0b]"
            out.append({r"\s": space, r"\Z": r"\z"}.get(pair, pair))
            k += 2
        elif inside:
            out.append(c)
            inside = None if c == "]" else inside
            k += 1
        elif c == "[":
            inside = "[^" if source.startswith("[^", k) else "["
            k += len(inside)
            out.append(inside)
            if source.startswith("]", k):
                out.append(r"\]")
                k += 1
        elif source.startswith(("(?=", "(?!", "(?<=", "(?<!"), k):
            k = _closing(source, k) + 1
        else:
            out.append(c)
            k += 1
    flags = "".join(f for f, on in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & on)
    loose = (f"(?{flags})" if flags else "") + "".join(out)
    try:
        pc.match_substring_regex(pa.array([""]), loose)
    except pa.ArrowInvalid:
        return None
    return loose


def _closing(source: str, k: int) -> int:
    """Where the group that opens at k closes."""
    depth, inside = 0, False
    while True:
        c = source[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            k += source.startswith("[^", k)
            k += source.startswith("]", k + 1)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return k
        k += 1


#: Whether a text may hold a match of a pattern.
May = Callable[[re.Pattern], bool]


def anywhere(pattern: re.Pattern) -> bool:
    return True


def probes(texts: Sequence[str]) -> list[May]:
    """For each text of a batch, whether it may hold a match of a pattern; a pattern runs over all of them when first asked for."""
    array, found = pa.array(texts, pa.large_string()), {}

    def of(k: int) -> May:
        def may(pattern: re.Pattern) -> bool:
            if pattern not in found:
                found[pattern] = set(hits(array, loosened(pattern)))
            return k in found[pattern]

        return may

    return [of(k) for k in range(len(texts))]


def hits(texts: pa.Array, loose: str | None) -> list[int]:
    """Places of the texts that may hold a match; all of them where no automaton tells."""
    return list(range(len(texts))) if loose is None else pc.indices_nonzero(pc.match_substring_regex(texts, loose)).to_pylist()
