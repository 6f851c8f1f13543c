import pytest

from tessera.operators import backtest
from tessera.plans.dag import PipelineConfig
from tessera.plans.research import market_panel, noise_sweep, parser, precision_study, research
from tessera.sources.panel import densify


@pytest.fixture(scope="module")
def config():
    return PipelineConfig(n_times=150, n_stocks=6, fwd=2, model_window=10, retrain_every=10, num_groups=2, initial_cash=1e6)


def test_run_from_market_to_books(spark, config):
    out = research(market_panel(spark, config), config, ("momentum", "counting"))
    signal = out.signal.toPandas()
    assert len(signal) and abs(signal.groupby("key")["pred_signal"].mean()).max() < 1e-9
    assert out.ic.where("abs(pearson_ic) <= 1 + 1e-9 and abs(rank_ic) <= 1 + 1e-9").count() == out.ic.count() > 0
    assert backtest.summary(out.nav).count() == 2


def test_noise_lowers_the_coefficient(spark, config):
    from dataclasses import replace

    rows = noise_sweep(spark, replace(config, n_times=120, n_stocks=20, fwd=5), (0.0, 4.0)).orderBy("noise_ratio").collect()
    assert rows[0].icir > rows[1].icir


def test_precision_study(spark, config):
    rows = precision_study(densify(market_panel(spark, config)), 2).collect()
    assert [r.decimals for r in rows] == [2, 6]


def test_settings_from_the_command_line():
    given = parser().parse_args(["--fwd", "5", "--ensemble", "ridge", "gbt", "--noise-ratio", "0.5"])
    assert (given.fwd, given.ensemble, given.noise_ratio, given.include_star) == (5, ["ridge", "gbt"], 0.5, False)
