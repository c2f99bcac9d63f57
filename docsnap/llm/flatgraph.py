"""A flat neighbour graph over the vectors of one shard: building, and search by range."""

from __future__ import annotations

import numpy as np

NEAREST, RANDOM, DEGREE = 48, 12, 24
ALPHA = 1.2
HOPS = 40
SLACK = 0.04


def medoid(vectors: np.ndarray) -> int:
    return int((vectors @ vectors.mean(axis=0)).argmax())


def robust_pruned(vectors: np.ndarray) -> list[np.ndarray]:
    """The neighbours of each row of unit vectors.

    Candidates are the nearest rows and some random ones. The nearest candidate becomes a
    neighbour and strikes out all that are closer to it, by ``ALPHA``, than to the row itself, and
    so on: what stays points into different directions.
    """
    size = len(vectors)
    if size < 2:
        return [np.zeros(0, np.int64)] * size
    likeness = vectors @ vectors.T
    np.fill_diagonal(likeness, -2)
    near = min(NEAREST, size - 1)
    candidates = np.argpartition(-likeness, near - 1, axis=1)[:, :near]
    random = np.random.default_rng(size).integers(0, size, (size, RANDOM))
    candidates = np.concatenate([candidates, random], axis=1)
    rows = np.arange(size)[:, None]
    order = np.argsort(-likeness[rows, candidates], axis=1, kind="stable")
    candidates = candidates[rows, order]
    distance = 1 - likeness[rows, candidates]
    alive = candidates != rows
    chosen = [[] for _ in range(DEGREE)]
    for k in range(DEGREE):
        pick = alive.argmax(axis=1)
        some = alive[np.arange(size), pick]
        best = candidates[np.arange(size), pick]
        chosen[k] = np.where(some, best, -1)
        alive &= candidates != best[:, None]
        struck = ALPHA * (1 - likeness[best[:, None], candidates]) <= distance
        alive &= ~(struck & some[:, None])
    table = np.stack(chosen, axis=1)
    return [np.unique(t[t >= 0]) for t in table]


def symmetric(neighbours: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges in both directions, as offsets and targets."""
    size = len(neighbours)
    source = np.repeat(np.arange(size), [len(n) for n in neighbours])
    target = np.concatenate(neighbours).astype(np.int64) if size else np.zeros(0, np.int64)
    both = np.unique(np.concatenate([source * size + target, target * size + source]))
    source, target = both // max(size, 1), both % max(size, 1)
    return np.searchsorted(source, np.arange(size + 1)), target


def expanded(rows: np.ndarray, at: np.ndarray, offsets: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query row and a neighbour of the point it stands on."""
    many = offsets[at + 1] - offsets[at]
    start = np.repeat(offsets[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
    return np.repeat(rows, many), targets[start + np.arange(many.sum())]


def range_search(
    queries: np.ndarray, points: np.ndarray, graph: tuple[np.ndarray, np.ndarray], least: float
) -> np.ndarray:
    """Which points each query finds within the cosine ``least``, less a slack.

    All queries walk at once: from the medoid each goes on from the best point not yet left, for a
    number of hops. Then the range grows: neighbours of what lies within it are looked at, until
    nothing new does.
    """
    offsets, targets = graph
    reach = np.full((len(queries), len(points)), -2, np.float32)
    left = np.zeros(reach.shape, bool)
    every = np.arange(len(queries))
    start = medoid(points)
    reach[:, start] = queries @ points[start]

    def look(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = reach[rows, at] == -2
        rows, at = rows[new], at[new]
        for k in range(0, len(rows), 1 << 16):
            part = slice(k, k + (1 << 16))
            reach[rows[part], at[part]] = np.einsum("ij,ij->i", queries[rows[part]], points[at[part]])
        return rows, at

    for _ in range(min(HOPS, len(points))):
        best = np.where(left, -3, reach).argmax(axis=1)
        live = ~left[every, best] & (reach[every, best] > -2)
        if not live.any():
            break
        left[every[live], best[live]] = True
        look(*expanded(every[live], best[live], offsets, targets))
    rows, at = np.nonzero((reach >= least - SLACK) & ~left)
    while len(rows):
        left[rows, at] = True
        rows, at = look(*expanded(rows, at, offsets, targets))
        pairs = np.unique(rows * len(points) + at)
        rows, at = pairs // len(points), pairs % len(points)
        within = (reach[rows, at] >= least - SLACK) & ~left[rows, at]
        rows, at = rows[within], at[within]
    return reach >= least - 1e-4
