"""Words of many texts as byte spans and 64-bit hashes, by arrays."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
ROOTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)     # odd: invertible modulo 2^64
_BYTE = np.random.default_rng(4).integers(1, 2**63, 256, np.uint64)     # a random value for each byte, A-Z as a-z
_BYTE[65:91] = _BYTE[97:123]
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[tuple[int, int], np.ndarray] = {}


def power(root: int, size: int) -> np.ndarray:
    """root^0, root^1, ... modulo 2^64, at least ``size`` of them; root -1: the inverse of root 0."""
    have = _powers.get(root)
    if have is None or len(have) < size:
        r = pow(int(ROOTS[0]), -1, 2**64) if root < 0 else int(ROOTS[root])
        size = 1 << max(10, (size - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(r)
        _powers[root] = have = np.multiply.accumulate(have)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of the texts that begin at ``at`` (its last item is the end of ``data``)."""
    solid = ~BLANK[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[False], solid[:-1]])
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.concatenate([solid[1:], [False]])
    after[at[1:][at[1:] > 0] - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` reads the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power(0, len(data))[:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, a polynomial in them."""
    return mixed((sums[end] - sums[start]) * power(-1, len(sums))[start])
