"""Reproducible random numbers: a hash of (seed, keys) instead of a generator with state.

The same row gets the same number whatever the partitioning, and again after a lost executor.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TWO53 = float(2**53)


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in the open interval (0, 1)."""
    cols = [F.lit(seed)] + [F.col(k) if isinstance(k, str) else k for k in keys]
    return (F.pmod(F.xxhash64(*cols), F.lit(2**53)).cast("double") + 0.5) / _TWO53


def hash_order(seed: int, *keys: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def exponential(u: Column, mean: Column | float) -> Column:
    return -F.log(F.lit(1.0) - u) * mean


def between(u: Column, lo, hi) -> Column:
    return lo + (hi - lo) * u


def triangular(u: Column, low: Column, mode: Column, high: Column) -> Column:
    """Inverse distribution function of the triangle (low, mode, high)."""
    width = high - low
    left = mode - low
    return (
        F.when(width <= 0, low)
        .when(u * width < left, low + F.sqrt(F.greatest(u * width * left, F.lit(0.0))))
        .otherwise(high - F.sqrt(F.greatest((1 - u) * width * (high - mode), F.lit(0.0))))
    )


def normal(u1: Column, u2: Column, mean=0.0, std=1.0) -> Column:
    """Box-Muller from two uniforms."""
    z = F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
    return mean + std * z


def lognormal(u1: Column, u2: Column, mean: Column, var: Column) -> Column:
    """Lognormal with the given mean and variance of the value itself."""
    s2 = F.log(1 + var / (mean * mean))
    return F.exp(normal(u1, u2, F.log(mean) - s2 / 2, F.sqrt(s2)))


def _mixed(seed: np.ndarray, salt: int) -> np.ndarray:
    """Uniforms in (0, 1) from 64-bit seeds and a number of the draw."""
    x = seed + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / _TWO53


@F.pandas_udf(DoubleType())
def normal_above(h: pd.Series, low: pd.Series) -> pd.Series:
    """Standard normal draws above ``low``, exact at any bound; ``h`` is a 64-bit hash that seeds each row.

    Up to 0.5 normals are redrawn until one is above; beyond, exponentials that start at the bound are redrawn until accepted. A null
    bound gives null.
    """
    a = low.to_numpy(float)
    out = np.full(len(a), np.nan)
    seed = h.to_numpy("int64").view("uint64")
    rate = (np.maximum(a, 0) + np.sqrt(np.maximum(a, 0) ** 2 + 4)) / 2
    todo, step = np.flatnonzero(~np.isnan(a)), 0
    with np.errstate(over="ignore"):
        while len(todo):
            u, v = _mixed(seed[todo], 2 * step + 1), _mixed(seed[todo], 2 * step + 2)
            tail = a[todo] > 0.5
            z = np.where(tail, a[todo] - np.log(u) / rate[todo], np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
            ok = np.where(tail, v < np.exp(-((z - rate[todo]) ** 2) / 2), z > a[todo])
            out[todo[ok]] = z[ok]
            todo = todo[~ok]
            step += 1
    return pd.Series([None if np.isnan(z) else z for z in out], dtype=object)


@F.pandas_udf(DoubleType())
def gamma(h: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    """Gamma draws; ``h`` is a 64-bit hash that seeds each row (squeeze method, redrawn until accepted)."""
    out = np.full(len(h), np.nan)
    k = shape.to_numpy(float)
    boost = k < 1
    d = np.where(boost, k + 1, k) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    seed = h.to_numpy("int64").view("uint64")
    todo = np.flatnonzero(k > 0)
    step = 0
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):

        def draw(ix, salt):
            return _mixed(seed[ix], salt)

        extra = draw(np.arange(len(k)), 1)
        while len(todo):
            z = np.sqrt(-2 * np.log(draw(todo, 3 * step + 2))) * np.cos(2 * np.pi * draw(todo, 3 * step + 3))
            v = (1 + c[todo] * z) ** 3
            ok = (v > 0) & (np.log(draw(todo, 3 * step + 4)) < 0.5 * z * z + d[todo] * (1 - v + np.log(v)))
            out[todo[ok]] = d[todo[ok]] * v[ok]
            todo = todo[~ok]
            step += 1
        out = np.where(boost, out * extra ** (1 / k), out)
    return pd.Series(out * scale.to_numpy(float))
