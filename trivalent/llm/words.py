"""White-space separated words of many texts at once: places and 64-bit hashes, in numpy over Arrow's buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D, within one text. Hashes are
64 bits wide; what depends on them is right unless two different words (or shingles) of
one comparison collide, a chance of about n*n / 2**65 over n distinct ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(29))


def buffer_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, eight zero bytes behind them, and the offset of each text. Nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, 8 * column.offset)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.zeros(last - first + 8, np.uint8)
    if last > first:
        raw[:-8] = np.frombuffer(data, np.uint8, last - first, first)
    return (LOWER[raw] if lower else raw), offsets - first


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    word = ~SPACE[raw[:-8]]
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[inner] = word[inner]
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    loads = np.ndarray((max(len(raw) - 7, 1),), np.uint64, raw, 0, (1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * M1 + M3)
    at, who = starts, None
    while len(at):
        part = loads[at] & LOW_BYTES[np.minimum(left, 8)]
        if who is None:
            h = mix((h ^ part) * M1)
        else:
            h[who] = mix((h[who] ^ part) * M1)
        more = np.flatnonzero(left > 8)
        at, left, who = at[more] + 8, left[more] - 8, more if who is None else who[more]
    return h


def hash_shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text, with each text's first place (one more at the end).

    A text of fewer words, one at least, has its whole sequence as its only run.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    places = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(places[-1], np.uint64)
    if len(words) >= size:
        rolled = np.full(len(words) - size + 1, M3)
        for k in range(size):
            rolled = mix((rolled ^ words[k : len(words) - size + 1 + k]) * M1)
        long = np.flatnonzero(counts >= size)
        take = np.arange(runs[long].sum()) + np.repeat(first[long] - np.concatenate([[0], np.cumsum(runs[long])[:-1]]), runs[long])
        put = np.arange(len(take)) + np.repeat(places[long] - np.concatenate([[0], np.cumsum(runs[long])[:-1]]), runs[long])
        out[put] = rolled[take]
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        h = np.full(1, M3 + np.uint64(counts[i]))
        for k in range(first[i], first[i + 1]):
            h = mix((h ^ words[k : k + 1]) * M1)
        out[places[i]] = h[0]
    return out, places


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
