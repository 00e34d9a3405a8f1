"""Coordinates as struct<x,y,z> columns: lengths, angles, dihedrals, topology, rigid alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: kcal/mol in one electronvolt.
EV_TO_KCAL = 23.060547830619026


def _sub(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return tuple(a[k] - b[k] for k in "xyz")


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def distance(a: Column, b: Column) -> Column:
    d = _sub(a, b)
    return F.sqrt(_dot(d, d))


def angle(a: Column, b: Column, c: Column) -> Column:
    """Degrees at b; null if a side has no length."""
    u, v = _sub(a, b), _sub(c, b)
    cos = F.try_divide(_dot(u, v), F.sqrt(_dot(u, u)) * F.sqrt(_dot(v, v)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Degrees in (-180, 180] about the bond b-c."""
    u, v, w = _sub(b, a), _sub(c, b), _sub(d, c)
    n, m = _cross(u, v), _cross(v, w)
    return F.degrees(F.atan2(F.sqrt(_dot(v, v)) * _dot(u, m), _dot(n, m)))


def circular(a: Column, b: Column) -> Column:
    """Least difference of two directions in degrees."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def palindrome_key(key: Column) -> Column:
    """The smaller of an array and its reverse."""
    return F.array_min(F.array(key, F.reverse(key)))


def topology_ok(bonds: DataFrame, key: str, length: str, expected: str, tolerance: float = 0.4) -> DataFrame:
    """(key, ok): every bond within the tolerance of its expected length."""
    return bonds.groupBy(key).agg(F.bool_and(F.abs(F.col(length) - F.col(expected)) <= tolerance * F.col(expected)).alias("ok"))


def kabsch(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation and shift that lay ``a`` on ``b`` with least squares, and the rmsd."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ turn @ u.T
    t = cb - r @ ca
    return r, t, float(np.sqrt((((a @ r.T + t) - b) ** 2).sum(1).mean()))


def energy_kcal(ev: Column) -> Column:
    """Electronvolts as kcal/mol."""
    return ev * EV_TO_KCAL


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest one-to-one assignment of a square table.

    Shortest augmenting paths with potentials: each row in turn takes a column,
    moving earlier rows along the cheapest path.
    """
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.full(n + 1, -1)  # row of a column; column n stands for the row to place
    for row in range(n):
        owner[n] = row
        least, back, done, j = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool), n
        while owner[j] >= 0:
            done[j] = True
            free = ~done[:n]
            gap = cost[owner[j]] - u[owner[j]] - v[:n]
            better = free & (gap < least)
            least[better], back[better] = gap[better], j
            step = least[free].min()
            nxt = int(np.flatnonzero(free)[least[free].argmin()])
            used = np.flatnonzero(done)
            u[owner[used]] += step
            v[used] -= step
            least[free] -= step
            j = nxt
        while j != n:
            owner[j], j = owner[back[j]], back[j]
    out = np.empty(n, np.int64)
    out[owner[:n]] = np.arange(n)
    return out


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``b`` in the order that brings its points nearest to those of ``a``."""
    return b[assignment(((a[:, None] - b[None]) ** 2).sum(2))]


def aligned_rmsd(df: DataFrame, key: str, a: str, b: str, match: bool = False) -> DataFrame:
    """(key, rmsd) of two arrays of points after rigid alignment, with ``match`` after their best assignment."""
    @F.pandas_udf("double")
    def rmsd(x: pd.Series, y: pd.Series) -> pd.Series:
        points = lambda v: np.array([list(p) for p in v], dtype=float)
        order = matched if match else lambda p, q: q
        return pd.Series([kabsch(points(p), order(points(p), points(q)))[2] if p is not None and q is not None and len(p) == len(q) and len(p) else None for p, q in zip(x, y, strict=True)])

    return df.select(key, rmsd(a, b).alias("rmsd"))


def quaternion_matrix(q: np.ndarray) -> np.ndarray:
    """Rotation of a quaternion (w, x, y, z) of any length but 0."""
    w, x, y, z = q / np.linalg.norm(q)
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ])
