"""Simple-8b word-aligned integer coding, vectorised with numpy.

A 64-bit word holds a 4-bit selector (top bits) and 60 payload bits. Selector s says how many values of how many bits
follow, first value in the lowest bits. Selector 0 is the escape: one value that needs more than 60 bits; its payload
is the value's index in the exception list that follows the words. A payload of a document or block is

    magic "S8B1" | n_values u32 | n_words u32 | n_exceptions u32 | words u64[n_words] | exceptions u64[n_exceptions]

all little-endian, so every payload decodes on its own and without a loop over its words.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
HEAD, HEAD_SIZE = "<4sIII", 16
#: Fixed values of the coding: (values, bits) for selectors 1 to 14.
SHAPES = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_LIMITS = np.array([1 << bits for _, bits in SHAPES], np.uint64)
_COUNTS = np.array([1] + [n for n, _ in SHAPES] + [0], np.int64)


def _selectors(values: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For every position the selector that packs most values from there on, at most left[i]; 0 where an escape is due."""
    n = len(values)
    kind = np.searchsorted(_LIMITS, values, side="right").astype(np.uint8)  # smallest class of SHAPES that holds it
    last = len(SHAPES)
    best = (kind < last).view(np.uint8)  # rank of the choice: 0 escape, 1 one value, ... 14 sixty values
    span, power = kind, 1  # span[i]: the largest class among the `power` values from i on
    for which in range(last - 2, -1, -1):
        count = SHAPES[which][0]
        if count > n:
            break
        while power * 2 <= count:
            span = np.maximum(span[:-power], span[power:])
            power *= 2
        end = n - count + 1
        fits = np.maximum(span[:end], span[count - power : count - power + end]) <= which
        fits &= left[:end] >= count
        np.maximum(best[:end], fits.view(np.uint8) * np.uint8(last - which), out=best[:end])
    return np.where(best, last + 1 - best, 0).astype(np.uint8)


def pack_all(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """One payload for each run of values; sizes[i] values make run i. An empty run gives a payload without words."""
    values = np.ascontiguousarray(values, np.uint64)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    n = len(values)
    left = np.minimum(np.repeat(ends, sizes) - np.arange(n), 60).astype(np.uint8)
    best = _selectors(values, left) if n else np.zeros(0, np.uint8)
    steps, starts, i = _COUNTS[best].astype(np.uint8).tobytes(), [], 0
    add = starts.append
    while i < n:
        add(i)
        i += steps[i]
    at = np.array(starts, np.int64)
    chosen = best[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    raised = at[chosen == 0]
    for s in np.unique(chosen):
        where = np.flatnonzero(chosen == s)
        if s == 0:  # the index counts from the first exception of the same run
            run = np.searchsorted(ends, raised, side="right")
            words[where] = np.arange(len(raised)) - np.searchsorted(raised, (ends - sizes)[run])
            continue
        count, bits = SHAPES[s - 1]
        word, first = words[where], at[where]
        for k in range(count):
            word |= values[first + k] << np.uint64(bits * k)
        words[where] = word
    cut, out_cut = [0, *np.searchsorted(at, ends).tolist()], [0, *np.searchsorted(raised, ends).tolist()]
    raw, more = words.astype("<u8").tobytes(), values[raised].astype("<u8").tobytes()
    return [
        struct.pack(HEAD, MAGIC, m, b - a, d - c) + raw[8 * a : 8 * b] + more[8 * c : 8 * d]
        for m, a, b, c, d in zip(np.asarray(sizes).tolist(), cut, cut[1:], out_cut, out_cut[1:])
    ]


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers -> payload."""
    return pack_all(values, np.array([len(values)]))[0]


def unpack_all(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all values one after another as uint64, values of each payload). Raises ValueError on a payload that is not whole."""
    sizes, words, raised, shift, at = [], [], [], [], 0
    for p in payloads:
        magic, n, n_words, n_raised = struct.unpack_from(HEAD, p)
        if magic != MAGIC or len(p) != HEAD_SIZE + 8 * (n_words + n_raised):
            raise ValueError("not a whole Simple-8b payload")
        sizes.append(n)
        words.append(p[HEAD_SIZE : HEAD_SIZE + 8 * n_words])
        raised.append(p[HEAD_SIZE + 8 * n_words :])
        shift.append((n_words, at))
        at += n_raised
    word = np.frombuffer(b"".join(words), "<u8")
    more = np.frombuffer(b"".join(raised), "<u8")
    chosen = (word >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[chosen]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    cuts = np.cumsum([w for w, _ in shift]) - 1
    held = np.where(cuts >= 0, ends[np.maximum(cuts, 0)], 0) if len(ends) else np.zeros(len(cuts), np.int64)
    if (np.diff(held, prepend=0) != np.array(sizes, np.int64)).any():
        raise ValueError("Simple-8b counts differ from the header")
    starts, out = ends - counts, np.empty(total, np.uint64)
    for s in np.unique(chosen):
        where = np.flatnonzero(chosen == s)
        if s == 0:
            base = np.repeat([b for _, b in shift], [w for w, _ in shift])[where]
            out[starts[where]] = more[base + (word[where] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        count, bits = SHAPES[s - 1]
        w, to, mask = word[where], starts[where], np.uint64((1 << bits) - 1)
        for k in range(count):
            out[to + k] = (w >> np.uint64(bits * k)) & mask
    return out, np.array(sizes, np.int64)


def unpack(payload: bytes) -> np.ndarray:
    return unpack_all([payload])[0]


def n_values(payload: bytes) -> int:
    """How many values a payload holds, from its header alone."""
    return struct.unpack_from(HEAD, payload)[1]
