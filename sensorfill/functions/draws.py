"""Random numbers that depend only on a row's keys.

A number is a function of the seed and the key columns, so it is the same for any
partitioning, after a retry and in another engine. ``md5`` is used because every
SQL engine has it; one digest feeds both lanes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # hexadecimal digits per number: 52 bits


def key_digest(seed: int, *keys: Column) -> Column:
    """One digest per key; ``keys`` must be non-null integers or strings."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(digest: Column, lane: int = 0) -> Column:
    """A number strictly between 0 and 1; lanes 0 and 1 are independent."""
    part = F.substring(digest, 1 + lane * _DIGITS, _DIGITS)
    return (F.conv(part, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def normal_pair(u1: Column, u2: Column) -> tuple[Column, Column]:
    """Two independent standard normal numbers from two uniforms."""
    radius = F.sqrt(-2.0 * F.ln(u1))
    return radius * F.cos(2.0 * math.pi * u2), radius * F.sin(2.0 * math.pi * u2)


def key_uniforms(seed: int, key: Sequence[object], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both lanes of ``uniform`` of the digests of a key and 1 to ``n``, in numpy."""
    start = hashlib.md5("|".join([str(seed), *map(str, key), ""]).encode())
    digests = bytearray()
    for i in range(1, n + 1):
        one = start.copy()
        one.update(b"%d" % i)
        digests += one.digest()
    b = np.frombuffer(bytes(digests), dtype=np.uint8).reshape(n, 16).astype(np.int64)
    # Thirteen half bytes a lane.
    first, second = b[:, 6] >> 4, b[:, 6] & 15
    high = sum(b[:, i] << (8 * (5 - i) + 4) for i in range(6))
    low = sum(b[:, i] << (8 * (12 - i)) for i in range(7, 13))
    return tuple((x + 0.5) / float(1 << 52) for x in (high + first, (second << 48) + low))


def thinned_poisson():
    """Pandas UDF of ``thinned_poisson_counts``."""
    return F.pandas_udf(thinned_poisson_counts(), "bigint")


def thinned_poisson_counts():
    """Function ``(trials, p, mean, u1, u2) -> count`` of arrays.

    ``B`` is the binomial quantile of (trials, p) at ``u1``; the result is the
    Poisson quantile of ``mean * B`` at ``u2``. With p = 1 and one trial it is a
    plain Poisson draw. A missing input gives a missing count.

    Quantiles are exact at any size: the least k whose distribution function
    reaches u. From few expected counts the function is summed up from zero. From
    many it is the incomplete gamma or beta integral, by quadrature, and k is
    stepped to from a normal expansion.
    """

    # Nested, so that the function is shipped whole to the Python workers.
    def count(trials, p, mean, u1, u2):
        from statistics import NormalDist

        import numpy as np
        import pandas as pd

        # Where summing up becomes slower than the quadrature; both are exact.
        many = 500.0
        nodes, weights = np.polynomial.legendre.leggauss(96)
        reach = 11.0  # standard deviations beyond which nothing is left

        def z_of(u):
            inverse = NormalDist().inv_cdf
            return np.fromiter((inverse(v) for v in u), dtype=float, count=len(u))

        def search(u, pmf, ratio):
            """Smallest k with cdf(k) >= u; ``ratio(rows, k)`` = pmf(k) / pmf(k - 1)."""
            out = np.zeros(len(u))
            rows, cdf, k = np.arange(len(u)), pmf.copy(), 0
            while rows.size:
                above = (u[rows] > cdf) & (pmf > 0.0)
                out[rows[~above]] = k
                rows, pmf, cdf, k = rows[above], pmf[above], cdf[above], k + 1
                pmf = pmf * ratio(rows, k)
                cdf = cdf + pmf
            return out

        def bend(x):
            """x - log(1 + x), by its series where the two nearly cancel."""
            series = np.zeros_like(x)
            for n in range(14, 1, -1):
                series = ((-1.0) ** n / n + series) * x
            return np.where(np.abs(x) < 0.05, series * x, x - np.log1p(x))

        def stirling(k):
            """ln k! less Stirling's formula, from 200 on to the last digit."""
            return (1 / 12 - (1 / 360 - 1 / 1260 / k**2) / k**2) / k

        def upper(start, peak, sd, low, high, density):
            """The integral of ``density(t - peak)`` from ``start`` to ``high``."""
            right = start >= peak
            a = np.where(right, start, np.maximum(low, start - reach * sd))
            b = np.where(right, np.minimum(high, start + reach * sd), start)
            half = (b - a) / 2
            at = (a + b)[:, None] / 2 - peak[:, None] + half[:, None] * nodes
            part = (density(at) * weights).sum(axis=1) * half
            return np.where(right, part, 1.0 - part)

        def poisson_cdf(k, m):
            top = np.exp(-stirling(k)) / np.sqrt(2 * np.pi * k)
            peak, high = k, np.full(len(k), np.inf)

            def density(y):
                with np.errstate(divide="ignore"):
                    return top[:, None] * np.exp(-k[:, None] * bend(y / k[:, None]))

            return upper(m, peak, np.sqrt(k), np.zeros(len(k)), high, density)

        def binomial_cdf(k, n, q):
            rest, size = n - 1 - k, n - 1
            s = k / size
            top = n * np.sqrt(size / (2 * np.pi * k * rest))
            top = top * np.exp(stirling(size) - stirling(k) - stirling(rest))

            def density(y):
                with np.errstate(divide="ignore"):
                    a = k[:, None] * bend(y / s[:, None])
                    b = rest[:, None] * bend(-y / (1 - s)[:, None])
                    return top[:, None] * np.exp(-a - b)

            sd = np.sqrt(s * (1 - s) / size)
            return upper(q, s, sd, np.zeros(len(k)), np.ones(len(k)), density)

        def step(k, u, cdf):
            """The least k with ``cdf(rows, k) >= u``, from a start that is close."""
            k, rows = k.copy(), np.arange(len(k))
            up = cdf(rows, k) < u
            climb, sink = rows[up], rows[~up]
            while climb.size:
                k[climb] += 1
                climb = climb[cdf(climb, k[climb]) < u[climb]]
            while sink.size:
                sink = sink[cdf(sink, k[sink] - 1) >= u[sink]]
                k[sink] -= 1
            return k

        def binomial(n, p, u):
            # Count the rarer outcome; mirroring u keeps it the same quantile.
            flip = p > 0.5
            q, v = np.where(flip, 1 - p, p), np.where(flip, 1 - u, u)
            out = np.zeros(len(n))
            big = n * q > many
            if big.any():
                n_b, q_b, v_b = n[big], q[big], v[big]
                z = z_of(v_b)
                skew = (1 - 2 * q_b) * (z * z - 1) / 6
                near = np.floor(n_b * q_b + np.sqrt(n_b * q_b * (1 - q_b)) * z + skew + 0.5)
                out[big] = step(near, v_b, lambda r, k: binomial_cdf(k, n_b[r], q_b[r]))
            n_s, q_s = n[~big], q[~big]
            out[~big] = search(
                v[~big],
                np.exp(n_s * np.log1p(-q_s)),
                lambda rows, k: (n_s[rows] - k + 1) / k * q_s[rows] / (1 - q_s[rows]),
            )
            return np.where(flip, n - out, out)

        def poisson(m, u):
            out = np.zeros(len(m))
            big = m > many
            if big.any():
                m_b, u_b = m[big], u[big]
                sd, z = np.sqrt(m_b), z_of(u_b)
                skew = (z * z - 1) / 6 + (z - z**3) / (72 * sd)
                near = np.floor(m_b + sd * z + skew + 0.5)
                out[big] = step(near, u_b, lambda r, k: poisson_cdf(k, m_b[r]))
            m_s = m[~big]
            out[~big] = search(u[~big], np.exp(-m_s), lambda rows, k: m_s[rows] / k)
            return out

        given = [np.asarray(s, dtype=float) for s in (trials, p, mean, u1, u2)]
        known = ~np.isnan(given).any(axis=0)
        n, q, m, v1, v2 = (x[known] for x in given)
        out = pd.Series(pd.NA, index=range(len(known)), dtype="Int64")
        out[known] = poisson(m * binomial(n, q, v1), v2).astype("int64")
        return out

    return count
