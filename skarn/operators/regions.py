"""Boxes around groups of neighbouring patches that are the best match of a query token, for many pairs at once.

A page is a grid of at most CELLS patches here, so the groups of every set of patches are looked up in a table.
"""

from __future__ import annotations

import functools

import numpy as np

#: Cells of a grid whose sets of patches are tabled.
CELLS = 16


def neighbours(at: int, width: int, height: int) -> list[int]:
    r, c = divmod(at, width)
    return [y * width + x for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= y < height and 0 <= x < width]


def groups_of(chosen: set[int], width: int, height: int) -> list[set[int]]:
    """The groups of neighbouring patches of chosen, by their smallest patch; patches behind the grid are groups of one."""
    groups, left = [], set(chosen)
    while left:
        group, edge = set(), [min(left)]
        while edge:
            at = edge.pop()
            if at in left:
                left.discard(at)
                group.add(at)
                edge += neighbours(at, width, height)
        groups.append(group)
    return groups


def box_of(group, width: int, height: int) -> tuple[float, float, float, float]:
    rows, cols = [p // width for p in group], [p % width for p in group]
    return max(min(cols) - 1, 0) / width, max(min(rows) - 1, 0) / height, min(max(cols) + 2, width) / width, min(max(rows) + 2, height) / height


@functools.cache
def tables(width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set of cells, as bits: its groups as sets, by smallest cell, 0 behind the last; its box; its size."""
    cells = width * height
    near = [sum(1 << n for n in neighbours(i, width, height)) for i in range(cells)]
    sets = np.arange(1 << cells, dtype=np.int64)
    groups, left = [], sets.copy()
    while left.any():
        group = left & -left
        while True:
            more = group.copy()
            for i in range(cells):
                more |= np.where(group >> i & 1, near[i], 0)
            more &= left
            if (more == group).all():
                break
            group = more
        groups.append(group)
        left &= ~group
    bits = sets[:, None] >> np.arange(cells) & 1
    rows, cols = np.arange(cells) // width, np.arange(cells) % width
    low = lambda of: np.where(bits, of, cells).min(1, initial=cells)
    high = lambda of: np.where(bits, of, -1).max(1, initial=-1)
    box = np.stack([np.maximum(low(cols) - 1, 0) / width, np.maximum(low(rows) - 1, 0) / height, np.minimum(high(cols) + 2, width) / width, np.minimum(high(rows) + 2, height) / height])
    return np.stack(groups, 1).astype(np.int32), box, bits.sum(1).astype(np.int32)


def slow_regions(best: np.ndarray, score: np.ndarray, width: int, height: int, most_patches: int, most: int):
    """The regions of one pair: boxes, scores and sizes."""
    chosen: dict[int, float] = {}
    for i in np.argsort(-score, kind="stable"):
        chosen[int(best[i])] = max(chosen.get(int(best[i]), -1e300), float(score[i]))
        if len(chosen) >= most_patches:
            break
    groups = groups_of(set(chosen), width, height)
    groups.sort(key=lambda g: (-max(chosen[p] for p in g), -len(g), min(g)))
    return [(*box_of(g, width, height), max(chosen[p] for p in g), len(g)) for g in groups[:most]]


def regions(best: np.ndarray, score: np.ndarray, width: int, height: int, most_patches: int, most: int) -> tuple[np.ndarray, ...]:
    """(pair, region, x0, y0, x1, y1, score, n) as arrays, for pairs in rows: each token's best patch and its score."""
    pairs, tokens = best.shape
    cells = width * height
    if cells > CELLS or (tokens and best.size and best.max() >= cells):
        rows = [(i, k, *r) for i in range(pairs) for k, r in enumerate(slow_regions(best[i], score[i], width, height, most_patches, most), 1)]
        return tuple(np.array([r[c] for r in rows]) for c in range(8)) if rows else tuple(np.zeros(0) for _ in range(8))
    value, every = np.full((pairs, cells), -np.inf), np.arange(pairs)
    for t in range(tokens):
        value[every, best[:, t]] = np.maximum(value[every, best[:, t]], score[:, t])
    if most_patches < min(cells, tokens):
        # a patch is chosen in the order of its first best token
        order = np.argsort(-score, axis=1, kind="stable")
        first = np.full((pairs, cells), tokens)
        for place in reversed(range(tokens)):
            first[every, best[every, order[:, place]]] = place
        value[np.argsort(np.argsort(first, axis=1), axis=1) >= most_patches] = -np.inf
    groups, box, size = tables(width, height)
    chosen = ((value > -np.inf) << np.arange(cells)).sum(1)
    pair, which = np.nonzero(groups[chosen])
    group = groups[chosen[pair], which]
    top = np.full(len(pair), -np.inf)
    for i in range(cells):
        np.maximum(top, value[pair, i], out=top, where=(group >> i & 1).astype(bool))
    order = np.lexsort((which, -size[group], -top, pair))
    pair, group, top = pair[order], group[order], top[order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    place = np.arange(len(pair)) - np.repeat(starts, np.diff([*starts, len(pair)])) + 1
    kept = place <= most
    pair, group, top, place = pair[kept], group[kept], top[kept], place[kept]
    return pair, place, *box[:, group], top, size[group]


def best_patches(tokens: np.ndarray, patches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For queries (n, tokens, d) and pages (m, patches, d): each token's first best patch and its score, (n * m, tokens)."""
    n, t, d = tokens.shape
    rows, m = tokens.reshape(n * t, d), len(patches)
    score = rows @ patches[:, 0].T
    best = np.zeros(score.shape, np.int16)
    for i in range(1, patches.shape[1]):
        sims = rows @ patches[:, i].T
        np.copyto(best, i, where=sims > score)
        np.maximum(score, sims, out=score)
    of = lambda x: x.reshape(n, t, m).transpose(0, 2, 1).reshape(n * m, t)
    return of(best), of(score)
