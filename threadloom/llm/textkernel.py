"""Column-at-a-time text work on Arrow batches: code points, word bounds, hashes.

A batch of texts becomes one array of code points; word and pre-token bounds
come from class tables, and the words' 64-bit hashes are made side by side, three
characters a step, so that no Python code runs per character or per word. Work goes
in pieces of at most ``CHUNK_CHARS`` characters (or one text, if it is longer), and
memory that a task has freed goes back to the system at its end, as Python workers live on.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_CHARS = 500_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White space as Unicode's White_Space property has it (fixed values).
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Between words for word shingles: space and tab to carriage return (fixed values).
PLAIN_WHITE = (32, 9, 10, 11, 12, 13)
#: Characters of a span that are hashed together: 21 bits each.
STEP = 3
#: Longer spans are hashed one by one.
LONG_SPAN = 96


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; what it freed goes back to the system when it ends."""

    @wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidy


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def unicode_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, stable, lower) of the code points of the basic plane.

    ``stable`` marks those whose class, composition and lower case no version of
    Unicode since 3.2 changes and that normalisation leaves alone wherever they
    stand; a text with others takes the library's own path.
    """
    old = unicodedata.ucd_3_2_0
    n = 0x10000
    kind, stable, lower = np.zeros(n, np.uint8), np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for c in range(n):
        ch = chr(c)
        cat = unicodedata.category(ch)
        kind[c] = LETTER if cat[0] == "L" else NUMBER if cat[0] == "N" else OTHER
        low = ch.lower()
        if len(low) == 1:
            lower[c] = ord(low)
        stable[c] = (
            (cat == old.category(ch) or c < 0x250)
            and cat not in ("Cn", "Cs", "Co", "Mn", "Mc", "Me")
            and len(low) == 1
            and not 0x1100 <= c < 0x1200
            and unicodedata.combining(ch) == 0
            and unicodedata.normalize("NFC", ch) == ch
        )
    kind[list(WHITE)] = SPACE
    return kind, stable, lower


@lru_cache(1)
def _plain_white() -> np.ndarray:
    t = np.zeros(0x10000, bool)
    t[list(PLAIN_WHITE)] = True
    return t


def look(table: np.ndarray, cps: np.ndarray) -> np.ndarray:
    """Entries of a table over the basic plane; code points beyond it share the last entry."""
    return table.take(cps) if cps.dtype == np.uint8 else table.take(cps, mode="clip")


def code_points(text: str) -> np.ndarray:
    """A text's code points, one byte each if all are below 256."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def to_text(cps: np.ndarray) -> str:
    return cps.tobytes().decode("latin-1" if cps.dtype == np.uint8 else "utf-32-le")


def lowered(cps: np.ndarray) -> np.ndarray:
    """Each character's own lower case."""
    table = unicode_tables()[2]
    if cps.dtype == np.uint8:
        return table[:256].astype(np.uint8).take(cps)
    return np.where(cps > 0xFFFF, cps, look(table, cps))


def sorted_unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def chunks(texts: pa.Array, max_rows: int = 1 << 30, max_chars: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, bounds) of pieces of a string array; nulls count as empty.

    ``bounds`` has one more entry than rows: text i has code points bounds[i]:bounds[i + 1].
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (max_chars or CHUNK_CHARS), side="right")) - 1)
        b = min(b, a + max_rows)
        part = pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), "")
        offsets = np.frombuffer(part.buffers()[1], np.int64, count=part.offset + len(part) + 1)[part.offset :]
        data = part.buffers()[2]
        raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
        yield a, b, code_points(str(raw, "utf-8")), ends[a : b + 1] - ends[a]
        a = b


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: its column ``text``, or that field of the rows it carries as one column."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def _steps(cps: np.ndarray) -> np.ndarray:
    """At each position its character and the two after it, as one number."""
    one = cps.astype(np.uint64)
    out = one.copy()
    for k in range(1, min(STEP, len(one))):
        out[:-k] |= one[k:] << np.uint64(21 * k)
    return out


#: What of a step belongs to a span with so many characters left.
_LEFT = np.array([(1 << 21 * k) - 1 for k in range(STEP + 1)], np.uint64)


def span_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's characters; equal spans get equal hashes.

    Every step goes through the whole finaliser, so that no pattern of characters
    cancels out. Spans that must not be taken for one another are compared as well
    (``distinct_spans``).
    """
    size = (ends - starts).astype(np.int64)
    h = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x9E3779B97F4A7C15)
    steps = _steps(cps)
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at = 0
    while len(live):
        v = steps[starts[live] + at] & _LEFT[np.minimum(size[live] - at, STEP)]
        h[live] = mix(h[live] ^ v)
        at += STEP
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(cps[starts[i] : ends[i]].astype("<u4").tobytes(), 0x51AB2E7F)
    return h


def same_spans(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the very characters of span ``other[i]``."""
    size = (ends - starts).astype(np.int64)
    same = (size == size[other]) & (other != np.arange(len(other)))
    steps = _steps(cps)
    live = np.flatnonzero(same & (size <= LONG_SPAN))
    at = 0
    while len(live):
        own = _LEFT[np.minimum(size[live] - at, STEP)]
        equal = steps[starts[live] + at] & own == steps[starts[other[live]] + at] & own
        same[live[~equal]] = False
        at += STEP
        live = live[equal & (size[live] > at)]
    for i in np.flatnonzero(same & (size > LONG_SPAN)).tolist():
        j = int(other[i])
        same[i] = np.array_equal(cps[starts[i] : ends[i]], cps[starts[j] : ends[j]])
    return same | (other == np.arange(len(other)))


def distinct_spans(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct span, where it first stands, index of each span's distinct one).

    Spans are told apart by their characters: two of them that share a hash are two.
    """
    keys, first, index = np.unique(span_hashes(cps, starts, ends), return_index=True, return_inverse=True)
    other = np.flatnonzero(~same_spans(cps, starts, ends, first[index]))
    if len(other):
        n, known = len(keys), {}
        shared = keys[index[other]]
        for i in other.tolist():
            index[i] = n + known.setdefault(cps[starts[i] : ends[i]].tobytes(), len(known))
        _, at = np.unique(index[other], return_index=True)
        keys, first = np.concatenate([keys, shared[at]]), np.concatenate([first, other[at]])
    return keys, first, index


def plain_words(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row bounds) of the words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    white = look(_plain_white(), cps)
    edge = np.zeros(len(cps) + 1, bool)
    edge[bounds] = True
    first = np.flatnonzero(~white & (edge[:-1] | np.concatenate([[True], white[:-1]])))
    last = np.flatnonzero(~white & (edge[1:] | np.concatenate([white[1:], [True]]))) + 1
    return first, last, np.searchsorted(first, bounds)


def fold_ascii(cps: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table.take(cps) if cps.dtype == np.uint8 else np.where((cps >= 65) & (cps <= 90), cps + np.uint32(32), cps)


def word_hashes(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row bounds) of each text's plain words, A-Z folded."""
    folded = fold_ascii(cps)
    first, last, rows = plain_words(folded, bounds)
    return span_hashes(folded, first, last), first, last, rows


_ROLL = [np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64)) for k in range(64)]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each position on (the last n - 1 have none)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _ROLL[0]
    for k in range(1, n):
        out += h[k : k + m] * _ROLL[k]
    return mix(out)


def positions_in_rows(row_bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of each n-gram of words that stays inside its row."""
    counts = np.maximum(np.diff(row_bounds) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    pos = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(row_bounds[:-1], counts)
    return rows, pos


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many runs, one after another."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)
