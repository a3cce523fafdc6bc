"""Pre-token bounds of the public tokenizers, by class tables instead of a regular expression.

Two patterns are known: the one of byte-level BPE, where one plain space joins
the run after it, and the one of lower-cased word BPE, where white space is
dropped and each digit stands alone. Special strings of the vocabulary are
bounds on both sides and one token each, as the library has it by default.
"""

from __future__ import annotations

import numpy as np

from threadloom.llm.textkernel import LETTER, NUMBER, OTHER, SPACE, look, unicode_tables

APOSTROPHE = 39
#: Endings that follow an apostrophe as one token (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def special_spans(cps: np.ndarray, bounds: np.ndarray, specials: tuple[str, ...]) -> list[tuple[int, int]]:
    """Spans of special strings, each inside one text."""
    spans = []
    hits = np.flatnonzero(cps[:-1] == 60) if len(cps) > 1 else []
    if len(hits):
        hits = hits[cps[hits + 1] == 124]
    taken = 0
    for i in hits:
        if i < taken:
            continue
        end = bounds[np.searchsorted(bounds, i, side="right")]
        for s in specials:
            j = i + len(s)
            if j <= end and "".join(map(chr, cps[i:j])) == s:
                spans.append((int(i), int(j)))
                taken = j
                break
    return spans


def _contractions(cps, kind, edge, at_start) -> list[tuple[np.ndarray, int]]:
    """(positions, length) of apostrophe endings at token starts."""
    n = len(cps)
    i = np.flatnonzero((cps == APOSTROPHE) & at_start)
    out = []
    for ending in ENDINGS:
        k = len(ending)
        ok = i[i + k < n]
        for j, ch in enumerate(ending, 1):
            ok = ok[(cps[ok + j] == ord(ch)) & ~edge[ok + j]]
        out.append((ok, k + 1))
    return out


def _runs(cps, bounds, specials):
    kind = look(unicode_tables()[0], cps)
    edge = np.zeros(len(cps) + 1, bool)
    edge[bounds] = True
    spans = special_spans(cps, bounds, specials)
    for a, b in spans:
        edge[[a, b]] = True
    change = np.ones(len(cps), bool)
    change[1:] = kind[1:] != kind[:-1]
    return kind, edge, change | edge[:-1], spans


def byte_level(cps: np.ndarray, bounds: np.ndarray, specials: tuple[str, ...]) -> np.ndarray:
    """Start positions of all pre-tokens; each ends where the next starts."""
    kind, edge, start, spans = _runs(cps, bounds, specials)
    n = len(cps)
    before = np.concatenate([[LETTER], kind[:-1]])
    space_before = np.concatenate([[0], cps[:-1]]) == 32
    at_start = start & (kind == OTHER) & (edge[:-1] | (before == LETTER) | (before == NUMBER) | ((before == SPACE) & ~space_before))
    endings = _contractions(cps, kind, edge, at_start)
    # A white run before something else in the same text gives up its last character.
    heads = np.flatnonzero(start & (kind != SPACE) & (before == SPACE) & ~edge[:-1])
    if len(heads):
        start[heads - 1] = True
        start[heads[cps[heads - 1] == 32]] = False
    for i, k in endings:
        start[i + 1] = False
        after = i + k
        start[after[after < n]] = True
    for a, b in spans:
        start[a:b] = False
        start[a] = True
    return np.flatnonzero(start)


def word_level(cps: np.ndarray, bounds: np.ndarray, specials: tuple[str, ...], raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of all pre-tokens of lower-cased text; ``raw`` is the text as it was."""
    kind, edge, start, _ = _runs(cps, bounds, ())
    n = len(cps)
    spans = special_spans(raw, bounds, specials)
    for a, b in spans:
        edge[[a, b]] = True
        start[a] = True
        if b < n:
            start[b] = True
    start |= kind == NUMBER
    at_start = start & (kind == OTHER)
    endings = _contractions(cps, kind, edge, at_start)
    for i, k in endings:
        start[i + 1] = False
        after = i + k
        start[after[after < n]] = True
    for a, b in spans:
        start[a:b] = False
        start[a] = True
        kind[a] = OTHER
    first = np.flatnonzero(start)
    last = np.append(first[1:], n)
    keep = kind[first] != SPACE
    return first[keep], last[keep]


def stable_rows(cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts have only characters that the tables are sure of."""
    bad = ~look(unicode_tables()[1], cps)
    if cps.dtype != np.uint8:
        bad |= cps > 0xFFFF
    if not bad.any():
        return np.ones(len(bounds) - 1, bool)
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[bounds[1:]] == total[bounds[:-1]]
