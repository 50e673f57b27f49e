"""SuperMinHash signatures of sets of 64-bit hashes.

Each element draws a permutation of the signature's places, a swap a step, and a rank at each step; a place keeps the least (step, rank) that any element brings it. As an
element takes each place at another step, places are negatively correlated, so the share of equal places varies less than with independent minhashes.
A set is done at the first step at which all its places are taken: what later steps bring would be larger.
"""

from __future__ import annotations

import numpy as np

from lacuna.llm.textvec import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_RANK = np.uint64(0xD6E8FEB86659FD93)
#: Sets of so many elements together are worked on at once, or one set.
AT_ONCE = 1 << 14


def draws(elements: np.ndarray, step: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """With which place each element swaps at this step (step to places - 1), and its rank there."""
    seed = mix(elements + np.uint64((step + 1) * int(_STEP) % 2**64))
    swap = np.uint64(step) + (((seed >> np.uint64(32)) * np.uint64(places - step)) >> np.uint64(32))
    return swap.astype(np.int64), mix(seed ^ _RANK)


def _signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * places, np.iinfo(np.uint64).max, np.uint64)
    taken = np.zeros(len(sets) * places, bool)
    rows = permuted = None
    for step in range(places):
        swap, rank = draws(elements, step, places)
        at = swap
        if permuted is not None:
            at = permuted[rows, swap].astype(np.int64)
            permuted[rows, swap] = permuted[rows, step]
            permuted[rows, step] = at
        cell = owner * places + at
        fresh = ~taken[cell]
        np.minimum.at(out, cell[fresh], rank[fresh])
        taken[cell] = True
        done = taken.reshape(-1, places).all(axis=1)
        if done.all():
            break
        going = ~done[owner]
        if permuted is None:
            # Most large sets are done by now; the others' permutations are kept from here on.
            elements, owner, swap = elements[going], owner[going], swap[going]
            rows = np.arange(len(elements))
            permuted = np.tile(np.arange(places, dtype=np.int32), (len(elements), 1))
            permuted[:, 0] = swap
            permuted[rows, swap] = 0
        else:
            elements, owner, rows = elements[going], owner[going], rows[going]
    return out.reshape(-1, places)


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """A row of places ranks for each set of distinct hashes; no set is empty."""
    out, begin = np.zeros((len(sets), places), np.uint64), 0
    ends = np.cumsum([len(s) for s in sets])
    while begin < len(sets):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        out[begin:end] = _signatures(sets[begin:end], places)
        begin = end
    return out


def bands(signed: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each run of rows places, and of where it stands."""
    cut = signed.reshape(len(signed), -1, rows)
    out = np.tile(np.arange(1, cut.shape[1] + 1, dtype=np.uint64) * _STEP, (len(signed), 1))
    for k in range(rows):
        out = mix(out ^ cut[:, :, k]) * _RANK
    return out
