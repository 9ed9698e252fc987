"""Counting quotient filters over sorted fingerprints.

A fingerprint of `width` bits is a quotient, its high q bits, and a remainder.
Remainders are held in order, packed to width - q bits; one bit for each
quotient says that it has a run of remainders (occupied) and one bit for each
remainder that its run ends there, so a run costs no slot of its own and no
fingerprint is lost: a filter gives back what was put in, in order. A third bit
says that the remainder was seen more than once; only such have a count.

Filters of parts, each sized by its own rows, merge losslessly: their sorted
fingerprints are merged and counts of equal ones added.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_HEAD = np.dtype([("n", "<u4"), ("many", "<u4"), ("q", "u1"), ("width", "u1")])


def added(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order and the sum of each one's counts. Sorted runs are merged."""
    if not len(fingerprints):
        return fingerprints, counts
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    start = np.nonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]])[0]
    return fingerprints[start], np.add.reduceat(counts, start)


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    """The low n bits of each value, packed one after the other."""
    return np.packbits(np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - n :])


def _numbers(packed: np.ndarray, rows: int, n: int) -> np.ndarray:
    wide = np.zeros((rows, 64), np.uint8)
    wide[:, 64 - n :] = np.unpackbits(packed, count=rows * n).reshape(rows, n)
    return np.packbits(wide, axis=1).view(">u8").astype(np.uint64).ravel()


def build(fingerprints: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """The filter of distinct fingerprints in order (uint64, under 2^width) with their counts, 1 at least."""
    n = len(fingerprints)
    q = min(width - 1, max(1, (n - 1).bit_length()))
    r = np.uint64(width - q)
    quotient = (fingerprints >> r).astype(np.int64)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotient] = 1
    ends = np.r_[quotient[1:] != quotient[:-1], np.ones(min(n, 1), bool)]
    many = counts > 1
    head = np.array([(n, int(many.sum()), q, width)], _HEAD)
    parts = (head, np.packbits(occupied), np.packbits(ends), np.packbits(many), _bits(fingerprints, width - q), counts[many].astype("<u8"))
    return b"".join(p.tobytes() for p in parts)


def read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints, in order, and counts of a filter."""
    head = np.frombuffer(data, _HEAD, 1)[0]
    n, q, width, at = int(head["n"]), int(head["q"]), int(head["width"]), _HEAD.itemsize

    def take(bits: int) -> np.ndarray:
        nonlocal at
        start, at = at, at + (bits + 7) // 8
        return np.frombuffer(data, np.uint8, at - start, start)

    quotients = np.nonzero(np.unpackbits(take(1 << q), count=1 << q))[0].astype(np.uint64)
    ends = np.unpackbits(take(n), count=n).astype(np.int64)
    many = np.unpackbits(take(n), count=n).astype(bool)
    remainders = _numbers(take(n * (width - q)), n, width - q)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(data, "<u8", int(head["many"]), at).astype(np.int64)
    run = np.cumsum(ends) - ends
    return (quotients[run] << np.uint64(width - q)) | remainders, counts


def merge(filters: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints, in order, and summed counts of several filters."""
    parts = [read(f) for f in filters]
    return added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
