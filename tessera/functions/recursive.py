"""Recursions over a window of rows that starts anew for every row, on numpy arrays of one code.

Row t sees the values of rows t - n + 1 to t, NaN where missing. All windows of a code advance
together: one step per place in the window, each over all rows, so a code of T rows takes n steps of T.
Rows before the first are missing and change nothing.
"""

from __future__ import annotations

import numpy as np


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` columns, the oldest place of each row's window first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n).T


def ewm(x: np.ndarray, span: int, n: int) -> list[np.ndarray]:
    """Exponential mean seeded with the window's first value; missing values leave it."""
    a = 2 / (span + 1)
    e = np.full(len(x), np.nan)
    for v in _windows(x, n):
        e = np.where(np.isnan(v), e, np.where(np.isnan(e), v, a * v + (1 - a) * e))
    return [e]


def ewm_adjusted(x: np.ndarray, span: int, least: int, n: int) -> list[np.ndarray]:
    """Weighted mean with weights that fade by the row, from ``least`` values on."""
    a = 2 / (span + 1)
    total, weight, count = np.zeros((3, len(x)))
    for v in _windows(x, n):
        seen = ~np.isnan(v)
        total = np.where(seen, (1 - a) * total + np.where(seen, v, 0), (1 - a) * total)
        weight = np.where(seen, (1 - a) * weight + 1, (1 - a) * weight)
        count += seen
    with np.errstate(invalid="ignore", divide="ignore"):
        return [np.where((count >= least) & (weight != 0), total / weight, np.nan)]


def macd(x: np.ndarray, fast: int, slow: int, signal: int, n: int) -> list[np.ndarray]:
    """The gap of two exponential means, and its distance to its own; a missing value repeats the last gap."""
    f, s, g = (2 / (k + 1) for k in (fast, slow, signal))
    xf, xs, xg = np.full((3, len(x)), np.nan)
    for v in _windows(x, n):
        missing = np.isnan(v)
        nf = np.where(missing, xf, np.where(np.isnan(xf), v, f * v + (1 - f) * xf))
        ns = np.where(missing, xs, np.where(np.isnan(xs), v, s * v + (1 - s) * xs))
        gap = nf - ns
        xg = np.where(np.isnan(gap), xg, np.where(np.isnan(xg), gap, g * gap + (1 - g) * xg))
        xf, xs = nf, ns
    return [xf - xs, xf - xs - xg]


def share_below(x: np.ndarray, least: int, start: int, n: int, day: np.ndarray) -> list[np.ndarray]:
    """(values up to the last one - 1) / (values - 1), from day ``start`` on and ``least`` values."""
    below, count = np.zeros((2, len(x)))
    with np.errstate(invalid="ignore"):
        for v in _windows(x, n):
            below += v <= x
            count += ~np.isnan(v)
    known = (day >= start) & ~np.isnan(x) & (count >= least)
    return [np.where(known, (below - 1) / np.maximum(count - 1, 1), np.nan)]


FUNCTIONS = {"ewm": ewm, "ewm_adjusted": ewm_adjusted, "macd": macd, "share_below": share_below}
