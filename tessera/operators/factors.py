"""The factor catalogue: twelve modules of columns over a dense panel, as kernel expressions.

Each module is a function of ``Kernels`` that returns ``{column: SQL}``. ``MODULES`` has their
window (rows that a day can see), the first day with output, and whether the module standardises its
own columns. ``raw`` gives a module's values and ``emitted`` what a node gives out: the trimmed
z-score over the day, missing as 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.functions.kernels import EPS, Kernels


def _div(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0))"


def _ln(x: str) -> str:
    return f"ln(case when {x} > 0 then {x} end)"


def _quarter(*parts: str) -> str:
    return f"(0.25e0 * ({' + '.join(parts)}))"


def momentum(k: Kernels) -> dict[str, str]:
    r = {p: k.pct("close", p) for p in (1, 3, 5, 10, 20, 40, 60, 120)}
    daily = k.hold(r[1])
    out = {f"factor_mom_ret_{p}d": r[p] for p in r}
    out |= {f"factor_mom_voladj_{p}d": f"({r[p]} / ({k.std(daily, max(p, 5))} + {EPS}))" for p in r}
    out |= {f"factor_rev_ret_{p}d": f"(-{r[p]})" for p in (1, 3, 5)}
    overnight = k.hold(f"{_div('open', k.lag('close'))} - 1")
    intraday = f"({_div('close', 'open')} - 1)"
    volume_rank, turnover_rank = k.cs_rank("volume"), k.cs_rank("turnover")
    z20 = k.zscore("close", 20)
    out |= {
        "factor_rev_overnight_1d": f"(-{overnight})",
        "factor_rev_overnight_5d": f"(-{k.mean(overnight, 5)})",
        "factor_rev_intraday_1d": f"(-{intraday})",
        "factor_rev_intraday_5d": f"(-{k.mean(intraday, 5)})",
        "factor_rev_volrev_1d": f"(-{daily} * {volume_rank})",
        "factor_rev_volrev_3d": f"(-{r[3]} * {volume_rank})",
    }
    out |= {f"factor_rev_zscore_{p}d": f"(-{z20})" for p in (1, 3, 5)}
    out |= {
        "factor_rev_gap_1d": f"(-{overnight} * coalesce({z20}, 0))",
        "factor_rev_range_rev": f"(-(high - low) / (close + {EPS}))",
        "factor_rev_turnover_1d": f"(-{daily} * {turnover_rank})",
        "factor_rev_composite": f"(-{_quarter(daily, overnight, intraday, f'{daily} * {volume_rank}')})",
    }
    return out


def volatility(k: Kernels) -> dict[str, str]:
    r = k.hold(k.pct("close"))
    hl, co = k.hold(f"{_ln('high / nullif(low, 0)')}"), k.hold(f"{_ln('close / nullif(open, 0)')}")
    out = {f"factor_vol_realized_{p}d": k.std(r, p) for p in (5, 10, 20, 60)}
    out |= {f"factor_vol_downside_{p}d": f"sqrt(abs({k.mean(f'(case when {r} < 0 then {r} else 0e0 end)', p)}))" for p in (5, 10, 20, 60)}
    out |= {f"factor_vol_of_vol_{p}d": k.std(k.std(r, q), p) for p, q in ((20, 5), (60, 20))}
    out |= {f"factor_vol_parkinson_{p}d": f"sqrt(abs({k.mean(f'({hl} * {hl} / (4 * ln(2e0)))', p)}))" for p in (5, 20)}
    out["factor_vol_gk_5d"] = f"sqrt(abs({k.mean(f'(0.5e0 * {hl} * {hl} - (2 * ln(2e0) - 1) * {co} * {co})', 5)}))"
    out |= {f"factor_vol_trend_{a}d": f"({_div(k.std(r, a), k.std(r, b))} - 1)" for a, b in ((20, 60), (60, 120))}
    out["factor_vol_range_20d"] = k.mean(f"({_div('high', 'low')} - 1)", 20)
    gap, spread = k.hold(f"{_div('open', k.lag('close'))} - 1"), _div("(high - low)", "close")
    position, opening = _div("(close - low)", "(high - low)"), _div("(open - low)", "(high - low)")
    direction, efficiency = _div("(close - open)", "(high - low)"), f"({gap} / ({spread} + 1e-6))"
    out |= {f"factor_intra_ret_mean_{p}d": k.mean(f"({_div('close', 'open')} - 1)", p) for p in (5, 20)}
    out |= {f"factor_intra_overnight_gap_{p}d": k.mean(gap, p) for p in (5, 20)}
    out |= {f"factor_intra_hl_range_{p}d": k.mean(spread, p) for p in (5, 20, 60)}
    out |= {f"factor_intra_close_position_{p}d": k.mean(position, p) for p in (5, 20)}
    out |= {f"factor_intra_open_position_{p}d": k.mean(opening, p) for p in (5, 20)}
    out |= {f"factor_intra_hl_vol_{p}d": k.std(hl, p) for p in (5, 20)}
    out |= {"factor_intra_directionality_5d": k.mean(direction, 5), "factor_intra_directionality_std_5d": k.std(direction, 5), "factor_intra_gap_efficiency_5d": k.mean(efficiency, 5)}
    out["factor_intra_composite"] = _quarter(k.mean(position, 5), k.mean(direction, 5), f"(-{k.mean(spread, 5)})", k.mean(efficiency, 5))
    return out


def liquidity(k: Kernels) -> dict[str, str]:
    r = k.hold(k.pct("close"))
    out = {f"factor_liq_turnover_{p}d": k.mean("turnover", p) for p in (5, 10, 20, 60)}
    out |= {f"factor_liq_turnover_chg_{p}d": f"({_div('turnover', k.mean('turnover', p))} - 1)" for p in (5, 10, 20, 60)}
    out |= {f"factor_liq_volume_chg_{p}d": f"({_div('volume', k.mean('volume', p))} - 1)" for p in (5, 20)}
    out |= {f"factor_liq_amihud_{p}d": k.mean(_div(f"abs({r})", "volume"), p) for p in (5, 20)}
    out |= {
        "factor_liq_dollar_vol": _ln("(close * volume)"),
        "factor_liq_dollar_vol_chg": k.pct("(close * volume)", 20),
        "factor_liq_turnover_vol_20d": k.std("turnover", 20),
    }
    out["factor_liq_composite"] = f"(-{out['factor_liq_amihud_20d']} - {out['factor_liq_turnover_vol_20d']})"
    change = k.hold(k.pct("market_cap"))
    size, rank, price = f"(-{_ln('market_cap')})", k.cs_rank("market_cap"), _ln(_div("market_cap", "close"))
    out |= {"factor_size_log_mcap": size, "factor_size_cs_rank": rank, "factor_size_quintile": rank}
    out |= {f"factor_size_mcap_chg_{p}d": k.pct("market_cap", p) for p in (5, 20, 60)}
    out |= {f"factor_size_mcap_mom_{p}d": k.pct("market_cap", p) for p in (5, 20)}
    out |= {f"factor_size_mcap_vol_{p}d": k.std(change, p) for p in (20, 60)}
    out |= {
        "factor_size_mcap_sqrt": "(-sqrt(case when market_cap >= 0 then market_cap end))",
        "factor_size_mcap_cube_root": "(-cbrt(market_cap))",
        "factor_size_price": price,
        "factor_size_small_and_rising": f"({size} * {k.pct('market_cap', 20)})",
        "factor_size_composite": _quarter(size, rank, out["factor_size_mcap_vol_20d"], price),
        "factor_size_residual_ret": k.cs_residual(k.hold(k.pct("close", 20)), "market_cap"),
    }
    return out


def value(k: Kernels) -> dict[str, str]:
    distance = {p: f"(-({_div('close', k.mean('close', p))} - 1))" for p in (20, 60, 120)}
    fall = {p: f"({_div('close', k.max('close', p))} - 1)" for p in (60, 120)}
    sharpe = f"(-((close - {k.expanding('close', 60, 'avg')}) / nullif({k.expanding('close', 60, 'stddev_samp')}, 0)))"
    low, high = k.min("close", 120), k.max("close", 120)
    out = {"factor_val_inv_price": _div("1e0", "close"), "factor_val_log_mcap": f"(-{_ln('market_cap')})", "factor_val_mcap_to_price": _div("market_cap", "close")}
    out |= {f"factor_val_dist_ma_{p}d": distance[p] for p in distance}
    out |= {f"factor_val_dd_{p}d": fall[p] for p in fall}
    out |= {
        "factor_val_turnover_yield": _div("1e0", "turnover"),
        "factor_val_sharpe_inv": sharpe,
        "factor_val_composite_short": f"(({out['factor_val_inv_price']} + {distance[20]} + {fall[60]}) / 3)",
        "factor_val_composite_long": f"(({distance[60]} + {distance[120]} + {fall[120]}) / 3)",
        "factor_val_inv_price_neut": k.cs_residual(out["factor_val_inv_price"], "market_cap"),
        "factor_val_dist_ma_60d_neut": k.cs_residual(k.hold(distance[60]), "market_cap"),
        "factor_val_cheap_low_turn": f"({distance[60]} - {k.cs_z('turnover')})",
        "factor_val_price_to_range": f"(-{_div(f'(close - {low})', f'({high} - {low})')})",
    }
    return out


def quality_merged(k: Kernels) -> dict[str, str]:
    r, r5, r20 = k.hold(k.pct("close")), k.hold(k.pct("close", 5)), k.hold(k.pct("close", 20))
    up = f"{r} > 0"
    steady = {p: _div("1e0", k.std(r, p)) for p in (20, 60, 120)}
    sharpe = {p: _div(k.mean(r, p), k.std(r, p)) for p in (20, 60, 120)}
    spread = _div("(high - low)", "close")
    out = {f"factor_qb_ret_stability_{p}d": steady[p] for p in steady} | {f"factor_qb_sharpe_{p}d": sharpe[p] for p in sharpe}
    out |= {f"factor_qb_pos_days_{p}d": k.share(up, p) for p in (20, 60, 120)}
    out |= {"factor_qb_stability_decay": _div(steady[20], steady[120]), "factor_qb_sharpe_decay": _div(sharpe[20], sharpe[120])}
    out |= {f"factor_qb_amp_stability_{p}d": _div("1e0", k.std(spread, p)) for p in (20, 60)}
    out |= {f"factor_qb_maxdd_{p}d": f"({_div('close', k.max('close', p))} - 1)" for p in (60, 120)}
    out["factor_qb_composite"] = _quarter(sharpe[60], k.share(up, 60), out["factor_qb_maxdd_60d"], steady[60])
    out |= {f"factor_qa_ddd_{p}d": k.since_peak("close", p) for p in (60, 120)}
    out["factor_qa_consec_sign_change_60d"] = k.flips(up, 60)
    z5, z20, zc = k.cs_z(r5), k.cs_z(r20), k.cs_z("close")
    by_cap, by_volume = k.cs_z(k.cs_residual("close", "market_cap")), k.cs_z(k.cs_residual(r20, "volume"))
    out |= {"factor_cs_momentum_5d": z5, "factor_cs_momentum_20d": z20, "factor_cs_close_zscore": zc, "factor_cs_close_neut_mcap": by_cap, "factor_cs_ret_neut_volume": by_volume}
    out["factor_cs_composite"] = _quarter(z20, zc, by_cap, by_volume)
    return out


def quality_pa(k: Kernels) -> dict[str, str]:
    r = k.hold(k.pct("close"))
    spread = f"({_div('high', 'low')} - 1)"
    out = {f"factor_qa_hl_stability_{p}d": _div("1e0", k.std(spread, p)) for p in (20, 60)}
    kurt, skew = {}, {}
    for p in (60, 120):
        kurt[p], skew[p] = k.moments(r, p)
    out |= {f"factor_qa_kurt_{p}d": kurt[p] for p in kurt} | {f"factor_qa_skew_{p}d": skew[p] for p in skew}
    out |= {"factor_qa_max_consec_pos_60d": k.first_run(f"{r} > 0", 60), "factor_qa_up_down_60d": k.up_down(r, 60)}
    out["factor_qa_composite"] = f"((({skew[60]}) + ({out['factor_qa_up_down_60d']})) / 2)"
    out |= {f"factor_qa_autocorr_{p}d": k.autocorr(r, p) for p in (20, 60)}
    out |= {f"factor_qa_tail_risk_{p}d": k.tail_risk(r, p) for p in (60, 120)}
    return out


def trend_cs(k: Kernels) -> dict[str, str]:
    mean = {p: k.mean("close", p) for p in (5, 10, 20, 60, 120)}
    out = {f"factor_trend_ma_{p}d": f"({_div('close', mean[p])} - 1)" for p in mean}
    out |= {f"factor_trend_ma_cross_{a}_{b}": f"({_div(mean[a], mean[b])} - 1)" for a, b in ((5, 20), (10, 60), (20, 120))}
    out["factor_trend_macd"], out["factor_trend_macd_signal"] = k.macd("close")
    channel = {p: _div(f"(close - {k.min('close', p)})", f"({k.max('close', p)} - {k.min('close', p)})") for p in (20, 60)}
    strength = {p: k.zscore("close", p) for p in (5, 20, 60)}
    out |= {f"factor_trend_channel_{p}d": channel[p] for p in channel} | {f"factor_trend_mom_strength_{p}d": strength[p] for p in (20, 60)}
    confirm = f"({out['factor_trend_ma_20d']} * {k.cs_z('volume')})"
    out |= {"factor_trend_vol_confirm": confirm, "factor_trend_composite": _quarter(out["factor_trend_macd_signal"], channel[20], strength[20], confirm)}
    rank = k.cs_rank("close")
    out |= {"factor_cs_rank_close": rank, "factor_cs_rank_volume": k.cs_rank("volume")}
    out |= {f"factor_cs_rank_delta_{p}d": f"({rank} - {k.lag(rank, p)})" for p in (5, 20, 60)}
    out |= {f"factor_cs_rank_zscore_{p}d": strength[p] for p in strength}
    out |= {f"factor_cs_ret_rank_{p}d": k.cs_rank(k.hold(k.pct("close", p))) for p in (1, 20)}
    return out


def counting(k: Kernels) -> dict[str, str]:
    r = k.hold(k.pct("close"))
    out = {f"factor_cnt_countpos_{p}d": k.flags(f"{r} > 0", p) for p in (10, 60)} | {f"factor_cnt_countneg_{p}d": k.flags(f"{r} < 0", p) for p in (10, 60)}
    out |= {"factor_cnt_consec_up_10d": k.streak(f"{r} > 0"), "factor_cnt_consec_down_10d": k.streak(f"{r} < 0")}
    before = k.lag(r)
    same = f"({r} > 0 and {before} > 0) or ({r} < 0 and {before} < 0)"
    out |= {f"factor_cnt_run_pct_{p}d": k.share(same, p) for p in (20, 60)}
    out |= {f"factor_cnt_tillnow_ret_{p}d": k.growth(r, p) for p in (20, 60)} | {f"factor_cnt_tillnow_dd_{p}d": k.drawdown("close", p) for p in (20, 60)}
    rank = k.cs_rank("turnover")
    moved = f"abs({rank} - {k.lag(rank)})"
    out |= {f"factor_cnt_turnover_rank_chg_{p}d": k.mean(moved, p) for p in (20, 60)}
    out |= {f"factor_cnt_new_high_{p}d": k.new_highs("close", p) for p in (20, 60)}
    out["factor_cnt_new_low_60d"] = k.new_highs("(-close)", 60)
    return out


def interaction(k: Kernels) -> dict[str, str]:
    r = {p: k.pct("close", p) for p in (1, 5, 20)}
    daily, spread = k.hold(r[1]), _div("(high - low)", "close")
    volume, turnover, cap = k.cs_rank("volume"), k.cs_rank("turnover"), k.cs_rank("market_cap")
    out = {f"factor_inter_ret_vol_{p}d": f"({r[p]} * {volume})" for p in (1, 5)}
    out |= {f"factor_inter_ret_turnover_{p}d": f"({r[p]} * {turnover})" for p in (1, 20)}
    out |= {f"factor_inter_ret_mcap_{p}d": f"({r[p]} * {cap})" for p in (5, 20)}
    out |= {f"factor_inter_vol_mcap_{p}d": f"({k.std(daily, p)} * {cap})" for p in (20, 60)}
    out |= {"factor_inter_hl_vol_1d": f"({spread} * {volume})", "factor_inter_hl_vol_5d": f"({spread} * {volume} * coalesce({r[5]}, 0))"}
    out |= {f"factor_inter_direction_range_{p}d": f"(sign({r[p]}) * {spread})" for p in (5, 20)}
    out |= {f"factor_inter_to_chg_ret_{p}d": f"({k.pct('turnover', p)} * {r[p]})" for p in (5, 20)}
    out["factor_inter_mom_vol_conflict"] = f"({r[20]} * {k.std(daily, 20)})"
    out["factor_inter_composite"] = _quarter(*(out[f"factor_inter_{n}"] for n in ("ret_vol_5d", "ret_mcap_20d", "direction_range_5d", "to_chg_ret_5d")))
    return out


def precision(k: Kernels) -> dict[str, str]:
    some = f"case when abs(vwap) > {EPS} then vwap end"
    dev, ratio = k.hold(f"(close - vwap) / {some}"), k.hold(f"close / {some}")
    out = {f"factor_vwap_ret_{p}d": k.pct("vwap", p) for p in (5, 20)}
    out |= {f"factor_vwap_deviation_{p}d": f"({_div('vwap', k.mean('vwap', p))} - 1)" for p in (5, 20)}
    step = k.hold(f"vwap - {k.lag('vwap')}")
    out |= {f"factor_grad_momentum_{p}d": _div(k.mean(step, p), k.mean("vwap", p)) for p in (5, 20, 60)}
    for s in (1, 2, 5):
        # C - C[2s] - (C[s] - C[2s]) over one code; missing until 2s rows have passed
        second = k.hold(f"(close - {k.lag('close', 2 * s)}) - ({k.lag('close', s)} - {k.lag('close', 2 * s)})")
        out |= {f"factor_grad_accel_{p}d_s{s}": _div(k.mean(second, p), k.std("vwap", p)) for p in (5, 20)}
    out["factor_cv_dev_inst"] = dev
    for p in (5, 20, 60):
        out |= {f"factor_cv_dev_mean_{p}d": k.mean(dev, p), f"factor_cv_dev_std_{p}d": k.std(dev, p), f"factor_cv_dev_zscore_{p}d": k.zscore(dev, p, EPS)}
    out |= {f"factor_cv_above_ratio_{p}d": k.share("close > vwap", p) for p in (5, 20, 60)}
    out |= {f"factor_cv_dev_diff_{p}d": f"({dev} - {k.lag(dev, p)})" for p in (5, 20)}
    change = f"({dev} - {k.lag(dev)} - ({k.lag(dev)} - {k.lag(dev, 2)}))"
    spread = lambda p: f"case when {k.std(dev, p)} > {EPS} then {k.std(dev, p)} end"
    out |= {f"factor_cv_dev_accel_{p}d": f"({k.mean(change, p)} / {spread(p)})" for p in (5, 20)}
    for p in (5, 20):
        product = k.hold(f"(close - {k.mean('close', p)}) * (vwap - {k.mean('vwap', p)})")
        sd = f"({k.std('close', p)} * {k.std('vwap', p)})"
        out[f"factor_cv_corr_{p}d"] = f"({k.mean(product, p)} / case when {sd} > {EPS} then {sd} end)"
    # 60 demeaned products never fit a window of 70 rows that starts with 59 rows without one
    out["factor_cv_corr_60d"] = "cast(null as double)"
    out |= {f"factor_cv_ratio_ma_{p}d": k.mean(ratio, p) for p in (5, 20, 60)} | {f"factor_cv_ratio_reversal_{p}d": f"({ratio} - {k.mean(ratio, p)})" for p in (5, 20, 60)}
    out |= {f"factor_cv_dev_cumsum_{p}d": f"({k.mean(dev, p)} * {p})" for p in (5, 20, 60)}
    above = "(case when close > vwap then 1e0 else 0e0 end)"
    crossed = k.hold(f"abs({above} - lag({above}, 1) over (partition by code order by day_idx))")
    out |= {f"factor_cv_cross_freq_{p}d": k.mean(crossed, p) for p in (5, 20)}
    return out


def tspct(k: Kernels) -> dict[str, str]:
    sources = {c: c for c in ("open", "high", "low", "close", "volume", "turnover")}
    sources |= {"on": k.hold(f"(open - {k.lag('close')}) / nullif({k.lag('close')}, 0)"), "id": k.hold("(close - open) / nullif(open, 0)")}
    return {f"factor_tspct_{name}_{p}d": k.rank_pct(x, p, 59) for name, x in sources.items() for p in (5, 20, 60)}


def valuation(k: Kernels) -> dict[str, str]:
    y = {"ep": k.hold(_div("1e0", "peTTM")), "bp": k.hold(_div("1e0", "pbMRQ")), "sp": k.hold(_div("1e0", "psTTM")), "cfp": k.hold(_div("1e0", "pcfNcfTTM"))}
    two = ("ep", "bp")
    r, r20 = k.hold(k.pct("close")), k.hold(k.pct("close", 20))
    out = {f"factor_est_{n}_1d": y[n] for n in y}
    out |= {f"factor_est_{n}_ma{p}": f"({_div(y[n], k.mean(y[n], p))} - 1)" for n in two for p in (20, 60)}
    z = {(n, p): k.zscore(y[n], p) for n in y for p in (60, 120)}
    out |= {f"factor_est_{n}_zscore_{p}d": z[n, p] for n in two for p in (60, 120)}
    out |= {f"factor_est_{n}_chg_20d": f"({_div(y[n], k.lag(y[n], 20))} - 1)" for n in two}
    rank = {n: k.cs_rank(y[n]) for n in two}
    out |= {f"factor_est_{n}_rank": rank[n] for n in two}
    out["factor_est_composite_2"] = f"(({z['ep', 60]} + {z['bp', 60]}) / 2)"
    out["factor_est_composite_4"] = f"(({' + '.join(z[n, 60] for n in y)}) / 4)"
    out["factor_est_cheap_quality"] = f"({z['ep', 60]} * (1 - {k.cs_z(k.std(r, 20))}))"
    out["factor_est_value_momentum"] = f"({rank['ep']} * {k.cs_rank(r20)})"
    out |= {f"factor_est_{n}_tspct_{p}d": k.rank_pct(y[n], p, p - 1) for n in two for p in (60, 120)}
    roe = k.hold(_div(y["ep"], y["bp"]))
    out |= {"factor_est_roe": roe, "factor_est_roe_chg_20d": f"({_div(roe, k.lag(roe, 20))} - 1)", "factor_est_roe_zscore_60d": k.zscore(roe, 60)}
    out |= {f"factor_est_{n}_vol_60d": k.std(y[n], 60) for n in two}
    out |= {f"factor_est_{n}_tspct_60d": f"(1 - {k.rank_pct(x, 60, 59)})" for n, x in (("pe", "peTTM"), ("pb", "pbMRQ"))}
    out["factor_est_spread"] = f"({rank['ep']} - {rank['bp']})"
    return out


@dataclass(frozen=True)
class Module:
    name: str
    columns: Callable[[Kernels], dict[str, str]]
    window: int
    first: int  # rows that the calendar must have
    inputs: tuple[str, ...]
    standardised: bool = False  # the module's own columns are z-scores


def _m(fn: Callable, window: int, inputs: str, standardised: bool = False) -> Module:
    return Module(fn.__name__, fn, window, 120 if window == 130 else 60, tuple(inputs.split()), standardised)


MODULES = {
    m.name: m
    for m in (
        _m(momentum, 130, "close open high low volume turnover"),
        _m(volatility, 130, "close open high low volume"),
        _m(liquidity, 70, "close volume turnover market_cap"),
        _m(value, 130, "close market_cap turnover"),
        _m(quality_merged, 130, "close high low market_cap volume", True),
        _m(quality_pa, 130, "close high low", True),
        _m(trend_cs, 130, "close volume", True),
        _m(counting, 70, "close turnover"),
        _m(interaction, 70, "close high low volume turnover market_cap"),
        _m(precision, 70, "close vwap"),
        _m(tspct, 70, "open high low close volume turnover"),
        _m(valuation, 130, "close peTTM pbMRQ psTTM pcfNcfTTM"),
    )
}


def raw_columns(k: Kernels, module: Module) -> dict[str, str]:
    out = module.columns(k)
    return {n: k.cs_z(k.hold(sql)) for n, sql in out.items()} if module.standardised else out


def emitted_columns(k: Kernels, module: Module, trim: float, digits: int | None) -> dict[str, str]:
    """What a node gives out: trimmed z-scores, missing as 0; ``+ 0e0`` turns -0 into 0."""
    out = {}
    for name, sql in raw_columns(k, module).items():
        z = k.cs_z_trimmed(k.hold(sql), trim)
        out[name] = z if digits is None else f"round({z} * 1.00000000001e0, {digits}) + 0e0"
    return out


def emitted(panel: DataFrame, module: str, trim: float = 0.01, digits: int | None = None, single: bool = False) -> DataFrame:
    """(key, code, factors) of a module over a dense panel, from the first day with output on.

    With ``single``, what goes into the node and what comes out of it is rounded to single precision.
    """
    m, k = MODULES[module], Kernels("spark", MODULES[module].window)
    columns = emitted_columns(k, m, trim, digits)
    narrow = (lambda x: f"cast(cast({x} as float) as double)") if single else (lambda x: x)
    kept = panel.selectExpr("code", "key", "day_idx", "present", *(f"{narrow(c)} as {c}" for c in m.inputs))
    out = k.apply(kept, columns, ("key", "code", "day_idx")).where(f"day_idx >= {m.first - 1}")
    return out.selectExpr("key", "code", *(f"{narrow(c)} as {c}" for c in columns))


def emitted_sql(source: str, module: str, trim: float = 0.01, digits: int | None = None) -> str:
    m, k = MODULES[module], Kernels("duckdb", MODULES[module].window)
    return k.query(source, emitted_columns(k, m, trim, digits), where=f"present and day_idx >= {m.first - 1}")


def catalogue() -> dict[str, list[str]]:
    return {name: list(m.columns(Kernels())) for name, m in MODULES.items()}
