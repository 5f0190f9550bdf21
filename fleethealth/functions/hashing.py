"""Spark's hash of strings where a batch of them is read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = np.uint64(42)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _turned(x + k * P2, 31) * P1


def _four(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _turned(h ^ (k * P1), 23) * P2 + P3


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _of_length(b: np.ndarray) -> np.ndarray:
    """xxHash64 of the rows of a matrix of bytes."""
    size, zero = b.shape[1], np.zeros(len(b), np.uint64)
    read = lambda lo, n: np.ascontiguousarray(b[:, lo : lo + n]).view(f"<u{n}").ravel().astype(np.uint64)
    at, h = 0, zero + SEED + P5
    if size >= 32:
        lanes = [zero + SEED + P1 + P2, zero + SEED + P2, zero + SEED, zero + SEED - P1]
        for at in range(0, size - 31, 32):
            lanes = [_round(x, read(at + 8 * i, 8)) for i, x in enumerate(lanes)]
        at += 32
        h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for x in lanes:
            h = (h ^ _round(zero, x)) * P1 + P4
    h = h + np.uint64(size)
    for at in range(at, size - 7, 8):  # noqa: B020
        h = _turned(h ^ _round(zero, read(at, 8)), 27) * P1 + P4
    at = size // 8 * 8
    if size - at >= 4:
        h, at = _four(h, read(at, 4)), at + 4
    for k in range(at, size):
        h = _turned(h ^ (b[:, k].astype(np.uint64) * P5), 11) * P1
    return _mixed(h)


def hashed(strings: pa.Array, number: int = 7) -> np.ndarray:
    """``F.xxhash64(string, F.lit(number))`` without its sign, for strings that aren't null."""
    strings = strings.cast(pa.large_string())
    out = np.zeros(len(strings), np.uint64)
    if not len(strings):
        return out
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data, sizes = np.frombuffer(strings.buffers()[2] or b"", np.uint8), np.diff(ends)
    order = np.argsort(sizes, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        out[mine] = _of_length(data[ends[mine, None] + np.arange(sizes[mine[0]])])
    return _mixed(_four(out + P5 + np.uint64(4), np.full(len(out), number, np.uint64)))
