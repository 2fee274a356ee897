"""Random numbers that are functions of (seed, id): the same as a column and as an array, so that a lost task draws them again."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxhash(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of eight bytes each, as Spark's xxhash64 takes a long."""
    h = (seed + _P5 + np.uint64(8)) ^ (_rotated(value * _P2, 31) * _P1)
    h = _rotated(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _uniform_np(ids: np.ndarray, seed: int, part: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.array([42], np.uint64)
        for v in (seed, part):
            h = _xxhash(np.array([v], np.int64).view(np.uint64), h)
        h = _xxhash(np.asarray(ids, np.int64).view(np.uint64), h)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normals(ids: np.ndarray, seed: int) -> np.ndarray:
    """A standard normal per id."""
    return np.sqrt(-2 * np.log(_uniform_np(ids, seed, 1))) * np.cos(2 * math.pi * _uniform_np(ids, seed, 2))


def normal(id_col: str, seed: int) -> Column:
    """The same as a column."""

    def uniform(part: int) -> Column:
        h = F.xxhash64(F.lit(seed).cast("long"), F.lit(part).cast("long"), F.col(id_col).cast("long"))
        return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(2.0**53)

    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * math.pi * uniform(2))
