"""Option pricing as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Abramowitz and Stegun 26.2.17.
P = 0.2316419
B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cdf(x: Column) -> Column:
    """Normal distribution function to 7 digits; neither engine has erf."""
    t = 1 / (1 + P * F.abs(x))
    tail = pdf(x) * t * (B[0] + t * (B[1] + t * (B[2] + t * (B[3] + t * B[4]))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _d1(s, k, t, r, v):
    return (F.log(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))


def black_scholes(call: Column, s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    """Price of a call or put; zero on inputs that are not positive."""
    d1 = _d1(s, k, t, r, v)
    d2 = d1 - v * F.sqrt(t)
    df = F.exp(-r * t)
    price = F.when(call, s * cdf(d1) - k * df * cdf(d2)).otherwise(k * df * cdf(-d2) - s * cdf(-d1))
    return F.when((s > 0) & (k > 0) & (t > 0) & (v > 0), price).otherwise(0.0)


def implied_volatility(call: Column, price: Column, s: Column, k: Column, t: Column, r: Column, low: float = 0.01, high: float = 5.0, steps: int = 60) -> Column:
    """Bisection in a fixed number of steps; null below intrinsic value or beyond the bracket.

    The steps run over whole Arrow batches: as a nested expression each step would
    evaluate the distribution anew for every row, outside generated code.
    """

    @F.pandas_udf("double")
    def solved(call: pd.Series, price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series) -> pd.Series:
        c, p, s, k, t, r = (x.to_numpy(float) for x in (call, price, s, k, t, r))
        with np.errstate(all="ignore"):
            lo, hi = np.full(len(p), low), np.full(len(p), high)
            inside = (p >= np.maximum(0, np.where(c > 0, s - k, k - s))) & (_price(c, s, k, t, r, lo) <= p) & (p <= _price(c, s, k, t, r, hi)) & (t > 0)
            for _ in range(steps):
                mid = (lo + hi) / 2
                less = _price(c, s, k, t, r, mid) < p
                lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
        return pd.Series(np.where(inside, (lo + hi) / 2, np.nan)).astype(object).where(inside, None)

    return solved(call.cast("double"), price, s, k, t, r)


#: Fixed values of the solver: the bracket of volatilities, a price's tick, and the most that a tick may move a volatility.
BRACKET, TICK, UNCERTAIN = (0.01, 3.0), 0.05, 0.05


def solve(c: np.ndarray, p: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, r: np.ndarray, most: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(volatility, what a tick moves it by, steps taken) for each premium ``p``; not a number where none reproduces it.

    Newton's steps on all that is still open at once, each kept within a bracket that
    shrinks: a step that would leave it, or that vega is too small for, halves it.
    """
    with np.errstate(all="ignore"):
        low, high = (np.full(len(p), x) for x in BRACKET)
        edge = np.maximum(0, np.where(c > 0, s - k * np.exp(-r * t), k * np.exp(-r * t) - s))
        known = (s > 0) & (k > 0) & (t > 0) & (p > edge + 1e-9) & (_price(c, s, k, t, r, low) <= p) & (p <= _price(c, s, k, t, r, high))
        v = np.clip(np.sqrt(2 * np.pi / t) * (p - edge / 2) / s, 0.05, 2.0)
        steps = np.zeros(len(p), np.int64)
        left = np.flatnonzero(known)
        for _ in range(most):
            if not len(left):
                break
            at = [x[left] for x in (c, s, k, t, r)]
            now = v[left]
            off = _price(*at, now) - p[left]
            low[left], high[left] = np.where(off < 0, now, low[left]), np.where(off < 0, high[left], now)
            to = now - off / _vega(*at[1:], now)
            to = np.where((to > low[left]) & (to < high[left]), to, (low[left] + high[left]) / 2)
            v[left] = to
            steps[left] += 1
            left = left[(np.abs(to - now) > 1e-13) & (high[left] - low[left] > 1e-14)]
        moved = TICK / _vega(s, k, t, r, v)
        return np.where(known, v, np.nan), np.where(known, moved, np.nan), steps


def solved_volatility(call: Column, price: Column, s: Column, k: Column, t: Column, r: Column) -> Column:
    """struct(iv, uncertainty, steps) by ``solve`` over Arrow batches; iv is null where no volatility gives the price, or a tick moves it too far."""

    @F.pandas_udf("iv double, uncertainty double, steps long")
    def solved(call: pd.Series, price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series) -> pd.DataFrame:
        iv, moved, steps = solve(*(x.to_numpy(float, na_value=np.nan) for x in (call, price, s, k, t, r)))
        none = lambda x, keep: pd.Series(x).astype(object).where(keep, None)
        return pd.DataFrame({"iv": none(iv, np.isfinite(iv) & (moved <= UNCERTAIN)), "uncertainty": none(moved, np.isfinite(moved)), "steps": steps})

    return solved(call.cast("double"), price, s, k, t, r)


def _vega(s: np.ndarray, k: np.ndarray, t: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    return s * np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * np.sqrt(t)


def _price(c: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Call where ``c`` is positive, else put, by the same distribution function as the columns."""
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    d2, df = d1 - v * np.sqrt(t), np.exp(-r * t)

    def phi(x: np.ndarray) -> np.ndarray:
        u = 1 / (1 + P * np.abs(x))
        tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * u * (B[0] + u * (B[1] + u * (B[2] + u * (B[3] + u * B[4]))))
        return np.where(x >= 0, 1 - tail, tail)

    return np.where(c > 0, s * phi(d1) - k * df * phi(d2), k * df * phi(-d2) - s * phi(-d1))


def greeks(call: Column, s: Column, k: Column, t: Column, r: Column, v: Column) -> dict[str, Column]:
    """delta, gamma, theta a day and vega a point."""
    d1 = _d1(s, k, t, r, v)
    d2 = d1 - v * F.sqrt(t)
    df = F.exp(-r * t)
    decay = -(s * pdf(d1) * v) / (2 * F.sqrt(t))
    return {
        "delta": F.when(call, cdf(d1)).otherwise(cdf(d1) - 1), "gamma": pdf(d1) / (s * v * F.sqrt(t)),
        "theta": F.when(call, decay - r * k * df * cdf(d2)).otherwise(decay + r * k * df * cdf(-d2)) / 365,
        "vega": s * pdf(d1) * F.sqrt(t) / 100}


def gamma_exposure(call: Column, gamma: Column, oi: Column, s: Column, lot: float = 1.0) -> Column:
    """Exposure to a move of 1 %: calls positive, puts negative; null where the interest is unknown."""
    return gamma * oi * lot * s * s * 0.01 * F.when(call, 1).otherwise(-1)
