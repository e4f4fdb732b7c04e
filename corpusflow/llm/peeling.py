"""Peeling of 3-uniform hypergraphs, under both the fuse filters and the perfect hash."""

from __future__ import annotations

import numpy as np


def peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Order the keys so that each has a slot that no later key uses.

    ``slots`` is keys x 3 with three different slots a key. Returns rounds of
    (keys, their own slots): within a round no key's own slot is a slot of
    another key of that round or of any later round. None when a core remains.
    """
    n = len(slots)
    flat = slots.ravel()
    degree = np.bincount(flat, minlength=size)
    held = np.zeros(size, dtype=np.int64)  # exclusive or of the keys still at a slot
    np.bitwise_xor.at(held, flat, np.repeat(np.arange(n), 3))
    rounds, done = [], 0
    front = np.flatnonzero(degree == 1)
    while len(front):
        keys, first = np.unique(held[front], return_index=True)
        rounds.append((keys, front[first]))
        done += len(keys)
        touched = slots[keys].ravel()
        np.subtract.at(degree, touched, 1)
        np.bitwise_xor.at(held, touched, np.repeat(keys, 3))
        front = np.unique(touched)
        front = front[degree[front] == 1]
    return rounds if done == n else None
