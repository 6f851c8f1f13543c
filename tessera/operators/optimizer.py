"""Long-only portfolio weights per day: alpha from the signal, a factor covariance, and a projected
gradient with momentum and an L1 price on turnover.

A day's problem is small (codes x history), so days run side by side in ``applyInPandas``; the
weights of the day before enter as a column.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def robust_z(x: np.ndarray, bound: float = 3.0) -> np.ndarray:
    mid = np.median(x)
    mad = np.median(np.abs(x - mid)) or 1.0
    return np.clip((x - mid) / mad, -bound, bound)


def expected_returns(signal: np.ndarray, volatility: np.ndarray, ic: float) -> np.ndarray:
    return ic * volatility * robust_z(signal)


def factor_covariance(returns: np.ndarray, factors: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loadings, factor variances and own variances of a (days x codes) history, by PCA."""
    x = returns - returns.mean(0)
    k = min(factors, *x.shape)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    n = max(1, len(x) - 1)
    loadings, variances = vt[:k].T, s[:k] ** 2 / n
    own = np.maximum((x * x).sum(0) / n - (loadings**2 * variances).sum(1), 1e-8)
    return loadings, variances, own


def risk_gradient(w: np.ndarray, cov: tuple) -> np.ndarray:
    b, f, d = cov
    return b @ (f * (b.T @ w)) + d * w


def risk(w: np.ndarray, cov: tuple) -> float:
    return float(w @ risk_gradient(w, cov))


def largest_eigenvalue(cov: tuple, rounds: int = 50, seed: int = 0) -> float:
    v = np.random.default_rng(seed).normal(size=len(cov[2]))
    value = 0.0
    for _ in range(rounds):
        v /= np.linalg.norm(v)
        v = risk_gradient(v, cov)
        value = float(np.linalg.norm(v))
    return value


def project(w: np.ndarray, cap: float, total: float = 1.0) -> np.ndarray:
    """Nearest weights in [0, cap] that sum to ``total``, by bisection of the shift."""
    if cap * len(w) <= total:
        return np.full(len(w), cap)
    low, high = w.min() - cap - total, w.max()
    for _ in range(100):
        mid = (low + high) / 2
        if np.clip(w - mid, 0, cap).sum() > total:
            low = mid
        else:
            high = mid
    return np.clip(w - (low + high) / 2, 0, cap)


def solve(alpha: np.ndarray, cov: tuple, before: np.ndarray, aversion: float = 5.0, cost: float = 0.001, cap: float = 0.1, rounds: int = 200) -> np.ndarray:
    """Weights that maximise alpha'w - aversion/2 w'Vw - cost * |w - before|."""
    step = 1 / max(aversion * largest_eigenvalue(cov), 1e-12)
    w = y = project(before, cap)
    t = 1.0
    for _ in range(rounds):
        g = y - step * (aversion * risk_gradient(y, cov) - alpha)
        moved = g - before
        new = project(before + np.sign(moved) * np.maximum(np.abs(moved) - step * cost, 0), cap)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-9:
            w = new
            break
        w, t = new, t_new
    return w


def allocate(signal: np.ndarray, returns: np.ndarray, before: np.ndarray, mean_ic: float, target: float = 0.15, **settings) -> np.ndarray:
    """Weights of a day: those before if the coefficient isn't positive, else scaled to the target risk."""
    if mean_ic <= 0:
        return before
    cov = factor_covariance(returns)
    w = solve(expected_returns(signal, returns.std(0), mean_ic), cov, before, **settings)
    yearly = np.sqrt(max(risk(w, cov), 0.0) * 252)
    return w * min(1.0, target / yearly) if yearly > 0 else w


def allocate_days(rows: DataFrame, mean_ic: float = 0.05, **settings) -> DataFrame:
    """``rows(key, code, pred_signal, history: array<double>, before)`` to ``(key, code, weight)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code")
        history = np.nan_to_num(np.stack([np.asarray(h, float) for h in pdf["history"]]).T)
        w = allocate(pdf["pred_signal"].to_numpy(float), history, pdf["before"].to_numpy(float), mean_ic, **settings)
        return pd.DataFrame({"key": pdf["key"], "code": pdf["code"], "weight": w})

    return rows.groupBy("key").applyInPandas(run, "key date, code string, weight double")


def allocate_path(rows: DataFrame, lookback: int = 60, mean_ic: float = 0.05, **settings) -> DataFrame:
    """``rows(key, code, pred_signal, ret)`` to ``(key, code, weight)``, each day from the day before.

    Every day with ``lookback`` days of returns is allocated; the weights handed on are those of the
    day before (equal ones at first, 0 for new codes). Days depend on each other, so one task passes over
    them in order; it holds ``lookback`` days of returns and one set of weights.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        past: deque[dict] = deque(maxlen=lookback)
        weights: dict | None = None

        def day(pdf: pd.DataFrame) -> pd.DataFrame | None:
            nonlocal weights
            codes = pdf["code"].tolist()
            past.append(dict(zip(codes, np.nan_to_num(pdf["ret"].to_numpy(float)))))
            if len(past) < lookback:
                return None
            history = np.array([[d.get(c, 0.0) for c in codes] for d in past])
            before = np.full(len(codes), 1 / len(codes)) if weights is None else np.array([weights.get(c, 0.0) for c in codes])
            w = allocate(np.nan_to_num(pdf["pred_signal"].to_numpy(float)), history, before, mean_ic, **settings)
            weights = dict(zip(codes, w))
            return pd.DataFrame({"key": pdf["key"], "code": codes, "weight": w})

        held, at = [], None
        for batch in batches:
            for key, pdf in batch.groupby("key", sort=True):
                if key != at and held:
                    out = day(pd.concat(held))
                    held = []
                    if out is not None:
                        yield out
                at = key
                held.append(pdf)
        if held and (out := day(pd.concat(held))) is not None:
            yield out

    ordered = rows.select("key", "code", "pred_signal", "ret").repartition(1).sortWithinPartitions("key", "code")
    return ordered.mapInPandas(run, "key date, code string, weight double")
