"""The full research run: panel, factors, labels, rolling models, ensemble, coefficients, back-test.

``research`` composes all of it as plans from a ``PipelineConfig``; ``python -m tessera.plans.research``
runs it on a simulated market and prints the summaries. ``noise_sweep`` and ``precision_study`` are
the two studies on top of it: the coefficient ratio must fall as noise grows, and shows what
rounding prices costs.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import Kernels
from tessera.operators import backtest, factors, models, signals
from tessera.plans.dag import Pipeline, PipelineConfig
from tessera.sources import panel as P
from tessera.sources.synthetic import synthetic_panel

#: Modules that need no valuation columns.
PRICE_MODULES = tuple(m for m in factors.MODULES if m != "valuation")


@dataclass
class Research:
    dense: DataFrame
    features: DataFrame
    signal: DataFrame
    ic: DataFrame
    nav: DataFrame
    n_days: int


def feature_frame(dense: DataFrame, modules: tuple[str, ...], trim: float) -> DataFrame:
    """The columns of several modules side by side, from the first day on which all of them give some out.

    One set of kernels holds them all, so what modules share is computed once and the panel is sorted by
    code and by day once for each turn between the two, whatever the number of modules.
    """
    chosen = [factors.MODULES[m] for m in modules]
    k = Kernels("spark", max(m.window for m in chosen))
    columns: dict[str, str] = {}
    for m in chosen:
        columns |= factors.emitted_columns(k, m, trim, None)
    inputs = sorted({c for m in chosen for c in m.inputs})
    kept = dense.select("code", "key", "day_idx", "present", *inputs)
    return k.apply(kept, columns, ("key", "code", "day_idx")).where(f"day_idx >= {max(m.first for m in chosen) - 1}")


def research(panel: DataFrame, config: PipelineConfig, modules: tuple[str, ...] = PRICE_MODULES) -> Research:
    """Plans of a whole run. The feature table is what every training date reads, so it is persisted."""
    dense = P.densify(P.clean(panel))
    n_days = P.calendar(panel).count()
    flow = Pipeline()
    flow.add_source("market", lambda: dense)
    flow.add_node("factors", lambda f: feature_frame(dense, modules, config.trim), "market", output=None)
    flow.add_node("labels", lambda f: signals.labels(dense, config.fwd, config.label_clip).select("key", "code", "label"), "market")
    made = flow.run()
    features = made["factors"].join(made["labels"], ["key", "code"], "left").persist()
    names = [c for c in features.columns if c.startswith("factor_")]
    first = max(factors.MODULES[m].first for m in modules) - 1
    rows = features.withColumn("day_idx", F.col("day_idx") - first)
    parts = []
    for m in config.ensemble:
        predicted = models.rolling_predictions(rows, names, n_days - first, m, config.model_window, config.fwd, config.retrain_every)
        parts.append(models.standardised(predicted, f"pred_signal_{m}").drop("day_idx"))
    both = reduce(lambda a, b: a.join(b, ["key", "code"]), parts).withColumns({"present": F.lit(True), "day_idx": F.lit(0)})
    k = Kernels()
    signal = k.apply(both, signals.ensemble_columns(k, [f"pred_signal_{m}" for m in config.ensemble]), ("key", "code"))
    market = dense.join(signal, ["key", "code"], "left")
    ic = signals.information_coefficients(market, "pred_signal", config.fwd, config.code_prefixes)
    tradable = dense.where("present and coalesce(isST, 0) = 0").select("key", "code").join(signal, ["key", "code"])
    if config.code_prefixes:
        from tessera.sources.vendor import starts

        tradable = tradable.where(starts(F.col("code"), config.code_prefixes))
    grouped = signals.groups(tradable, config.num_groups)
    rules = backtest.Rules(config.fwd, config.initial_cash, config.commission_rate, config.min_commission, config.slip_ticks, config.precision)
    nav = backtest.backtest(dense.where("present"), grouped, config.num_groups, rules)
    return Research(dense, features, signal, ic, nav, n_days)


def market_panel(spark: SparkSession, config: PipelineConfig) -> DataFrame:
    return synthetic_panel(spark, n_times=config.n_times, n_stocks=config.n_stocks, noise_ratio=config.noise_ratio, seed=config.seed, start_date=config.start_date, precision=config.precision)


def signal_quality(dense: DataFrame, fwd: int, column: str = "close") -> DataFrame:
    """Summary of the coefficients of a plain reversal signal; what the studies compare."""
    k = Kernels()
    signal = f"(-{k.pct(column, 5)})"
    for stage in k.stages([signal]):
        dense = dense.selectExpr("*", *(f"{k.nodes[n][1]} as {n}" for n in stage))
    market = dense.withColumn("signal", F.expr(signal)).drop(*k.nodes)
    return signals.ic_summary(signals.information_coefficients(market, "signal", fwd))


def noise_sweep(spark: SparkSession, config: PipelineConfig, ratios: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """``(noise_ratio, icir)`` of the simulator's own signal for several noise levels."""
    out = None
    for r in ratios:
        dense = P.densify(market_panel(spark, replace(config, noise_ratio=r)))
        k = Kernels()
        ahead = k.pct("close", 1)
        for stage in k.stages([ahead]):
            dense = dense.selectExpr("*", *(f"{k.nodes[n][1]} as {n}" for n in stage))
        row = signals.ic_summary(signals.information_coefficients(dense.withColumn("signal", F.expr(ahead)).drop(*k.nodes), "signal", config.fwd)).select(F.lit(r).alias("noise_ratio"), "icir", "mean_ic")
        out = row if out is None else out.unionByName(row)
    return out


def precision_study(dense: DataFrame, fwd: int, decimals: tuple[int, ...] = (2, 6)) -> DataFrame:
    """The reversal signal's summary with closes rounded to several numbers of decimals."""
    out = None
    for d in decimals:
        row = signal_quality(dense.withColumn("rounded", F.bround("close", d)), fwd, "rounded").select(F.lit(d).alias("decimals"), "n", "mean_ic", "icir")
        out = row if out is None else out.unionByName(row)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Run factors, models, coefficients and back-test on a simulated market.")
    for f in fields(PipelineConfig):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(name, action="store_true", default=f.default)
        elif isinstance(f.default, tuple):
            p.add_argument(name, nargs="*", default=f.default)
        else:
            p.add_argument(name, type=int if f.default is None else type(f.default), default=f.default)
    return p


def main(args: list[str] | None = None) -> None:
    given = vars(parser().parse_args(args))
    config = PipelineConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    spark = SparkSession.builder.appName("research").getOrCreate()
    out = research(market_panel(spark, config), config)
    signals.ic_summary(out.ic).show(truncate=False)
    backtest.summary(out.nav).orderBy("group_id").show(truncate=False)


if __name__ == "__main__":
    main()
