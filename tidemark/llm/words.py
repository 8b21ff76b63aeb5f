"""Words of many texts at once: places between ASCII white space, and 64-bit hashes, all in arrays."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Fixed odd multipliers and offsets of the two lanes.
_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ADD = (np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))

#: Words or windows that are hashed at a time: what is held beside the hashes does not grow with a block.
STEP = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of what stands between ASCII white space."""
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(_SPACE[np.frombuffer(raw, np.uint8)], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes, begin: np.ndarray, end: np.ndarray, lanes: int = 2) -> np.ndarray:
    """A row of hashes for each lane: of eight bytes at a time, each mixed into what came before."""
    padded = raw + bytes(8)
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    out = np.empty((lanes, len(begin)), np.uint64)
    for a in range(0, len(begin), STEP):
        _hash(eights, begin[a : a + STEP], end[a : a + STEP], out[:, a : a + STEP])
    return out


def _hash(eights: np.ndarray, begin: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
    lanes, size = len(out), end - begin
    first = eights[begin] & _KEPT[np.minimum(size, 8)]
    for k in range(lanes):
        out[k] = mixed(first * _MULTIPLY[k] + size.astype(np.uint64) * _ADD[k])
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        part = eights[begin[more] + at] & _KEPT[np.minimum(size[more] - at, 8)]
        for k in range(lanes):
            out[k, more] = mixed((out[k, more] ^ part) * _MULTIPLY[k] + _ADD[k])
        at += 8
        more = more[size[more] > at]
