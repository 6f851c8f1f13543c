import numpy as np
import pandas as pd
import pytest

from tessera.functions.kernels import Kernels
from tessera.operators import factors
from tessera.sources.panel import densify
from tessera.sources.synthetic import synthetic_panel


def test_catalogue_sizes():
    sizes = {n: len(c) for n, c in factors.catalogue().items()}
    assert sizes == {"momentum": 32, "volatility": 33, "liquidity": 32, "value": 16, "quality_merged": 25, "quality_pa": 13, "trend_cs": 26, "counting": 17, "interaction": 16, "precision": 44, "tspct": 24, "valuation": 32}
    assert sum(sizes.values()) == 310


@pytest.fixture(scope="module")
def market(spark):
    return densify(synthetic_panel(spark, n_times=130, n_stocks=6, seed=3)).cache()


@pytest.fixture(scope="module")
def close(market):
    return market.toPandas().pivot(index="day_idx", columns="code", values="close")


def raw(market, module, column):
    m, k = factors.MODULES[module], Kernels("spark", factors.MODULES[module].window)
    out = k.apply(market, {"x": m.columns(k)[column]}, ("key", "code", "day_idx")).toPandas()
    return out.pivot(index="day_idx", columns="code", values="x").astype(float)


def same(a, b, from_day):
    a, b = a.loc[from_day:], b.loc[from_day:]
    assert a.notna().to_numpy().any()
    pd.testing.assert_frame_equal(a, b, check_names=False, rtol=1e-9, atol=1e-12)


def test_momentum(market, close):
    r = close / close.shift(1) - 1
    same(raw(market, "momentum", "factor_mom_ret_20d"), close / close.shift(20) - 1, 120)
    same(raw(market, "momentum", "factor_mom_voladj_5d"), (close / close.shift(5) - 1) / (r.rolling(5).std(ddof=0) + 1e-8), 120)
    same(raw(market, "momentum", "factor_rev_zscore_1d"), -(close - close.rolling(20).mean()) / close.rolling(20).std(ddof=0), 120)


def test_volatility(market, close):
    r = close / close.shift(1) - 1
    same(raw(market, "volatility", "factor_vol_of_vol_20d"), r.rolling(5).std(ddof=0).rolling(20).std(ddof=0), 120)
    same(raw(market, "volatility", "factor_vol_downside_20d"), np.sqrt(r.where(r < 0, 0).rolling(20).mean().abs()), 120)


def test_trend(market, close):
    def ewm(x, span):
        return x.ewm(span=span, adjust=False).mean()

    # day 129 sees all 130 rows, so the means start at the first one
    macd = ewm(close, 12) - ewm(close, 26)
    same(raw(market, "trend_cs", "factor_trend_macd"), macd, 129)
    same(raw(market, "trend_cs", "factor_trend_macd_signal"), macd - ewm(macd, 9), 129)
    rank = close.rank(axis=1).sub(1).div(close.notna().sum(axis=1) - 1, axis=0)
    same(raw(market, "trend_cs", "factor_cs_rank_delta_5d"), rank - rank.shift(5), 120)


def test_quality(market, close):
    r = close / close.shift(1) - 1
    m = lambda p: (r**p).rolling(60).mean()
    var = (m(2) - m(1) ** 2).clip(lower=1e-15)
    same(raw(market, "quality_pa", "factor_qa_skew_60d"), (m(3) - 3 * m(1) * m(2) + 2 * m(1) ** 3) / var**1.5, 120)
    since = close.rolling(60).apply(lambda v: len(v) - 1 - int(np.argmax(v)), raw=True)
    same(raw(market, "quality_merged", "factor_qa_ddd_60d"), since, 120)


def test_emitted_is_standardised(market):
    out = factors.emitted(market, "momentum").toPandas()
    cols = [c for c in out.columns if c.startswith("factor_")]
    assert out[cols].notna().all().all()
    spread = out.groupby("key")[cols].std()
    assert np.allclose(spread[(spread > 0.01)].stack(), 1, atol=1e-6)
    assert np.allclose(out.groupby("key")[cols].mean(), 0, atol=1e-6)


def test_single_precision_between_nodes(market):
    got = factors.emitted(market, "momentum", single=True).toPandas().sort_values(["key", "code"])
    cols = [c for c in got.columns if c.startswith("factor_")]
    x = got[cols].to_numpy()
    assert np.array_equal(x, x.astype(np.float32).astype(float))
    inputs = factors.MODULES["momentum"].inputs
    narrow = market.selectExpr(*(f"cast(cast({c} as float) as double) as {c}" if c in inputs else c for c in market.columns))
    want = factors.emitted(narrow, "momentum").toPandas().sort_values(["key", "code"])
    assert np.array_equal(x, want[cols].to_numpy().astype(np.float32).astype(float))


def test_correlation_over_60_days_never_fits():
    assert factors.precision(Kernels())["factor_cv_corr_60d"] == "cast(null as double)"
