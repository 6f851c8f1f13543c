"""Every column of the factor catalogue against numpy code written from the definitions, with missing cells."""

import datetime as dt
import warnings

import numpy as np
import pytest

from tessera.functions.kernels import Kernels
from tessera.operators import factors

T, S, EPS = 150, 7, 1e-8
COLUMNS = "open high low close vwap volume turnover market_cap peTTM pbMRQ psTTM pcfNcfTTM".split()


def simulated():
    rng = np.random.default_rng(17)
    close = 20 * np.exp(np.cumsum(rng.normal(0, 0.02, (T, S)), 0))
    open_ = close * np.exp(rng.normal(0, 0.01, (T, S)))
    out = {"open": open_, "high": np.maximum(open_, close) * (1 + abs(rng.normal(0, 0.01, (T, S)))), "low": np.minimum(open_, close) * (1 - abs(rng.normal(0, 0.01, (T, S)))), "close": close}
    out |= {"vwap": close * np.exp(rng.normal(0, 0.005, (T, S))), "volume": rng.lognormal(10, 1, (T, S)), "turnover": rng.lognormal(-4, 1, (T, S)), "market_cap": close * rng.lognormal(8, 1, S)}
    out |= {n: rng.lognormal(2, 0.3, (T, S)) * rng.choice([-1, 1, 1, 1], (T, S)) for n in COLUMNS[8:]}
    gone = rng.random((T, S)) < 0.02
    return {n: np.where(gone, np.nan, x) for n, x in out.items()}


DATA = simulated()
O, H, L, C, VW, V, TO, MC, PE, PB, PS, PCF = (DATA[n] for n in COLUMNS)


def lag(x, n=1):
    return np.vstack([np.full((n, S), np.nan), x[:-n]])


def div(a, b):
    return np.divide(a, b, out=np.full((T, S), np.nan), where=(b != 0) & ~np.isnan(a * b))


def pct(x, n=1):
    return div(x - lag(x, n), lag(x, n))


def frames(x, w):
    """(T, S, w): the last w rows of every row, NaN before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.vstack([np.full((w - 1, S), np.nan), x]), w, 0)


def roll(fn, x, w, half=True, start=None):
    f = frames(np.asarray(x, float), w)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        y = fn(f)
    ok = np.arange(T)[:, None] >= (w - 1 if start is None else start)
    if half:
        ok = ok & ((~np.isnan(f)).sum(2) >= max(1, w // 2))
    return np.where(ok, y, np.nan)


mean = lambda x, w, start=None: roll(lambda f: np.nanmean(f, 2), x, w, start=start)
sd = lambda x, w: roll(lambda f: np.nanstd(f, 2), x, w)
low = lambda x, w: roll(lambda f: np.nanmin(f, 2), x, w, False)
high = lambda x, w: roll(lambda f: np.nanmax(f, 2), x, w, False)
flags = lambda c, w: roll(lambda f: f.sum(2), c.astype(float), w, False)
each = lambda fn, x, w: roll(lambda f: np.array([[fn(v) for v in row] for row in f], float), x, w, False)
positive = lambda x: np.where(x > 0, x, np.nan)
zs = lambda x, w, least=0.0: div(x - mean(x, w), np.where(sd(x, w) > least, sd(x, w), np.nan))


def rank(x):
    below = (x[:, None, :] < x[:, :, None]).sum(2)
    same = (x[:, None, :] == x[:, :, None]).sum(2)
    return np.where(np.isnan(x), np.nan, (below + (same + 1) / 2 - 1) / (S - 1))


def z(x):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = (x - np.nanmean(x, 1, keepdims=True)) / np.nanstd(x, 1, ddof=1, keepdims=True)
    return np.where(np.isfinite(out), out, 0.0)


def residual(y, by):
    b, out = z(by), np.full((T, S), np.nan)
    for t in range(T):
        ok = ~np.isnan(y[t])
        if ok.sum() < 3:
            out[t, ok] = y[t, ok] - y[t, ok].mean() if ok.any() else np.nan
        else:
            out[t, ok] = y[t, ok] - b[t, ok] * np.linalg.lstsq(b[t, ok, None], y[t, ok], rcond=None)[0][0]
    return out


def ewm(x, span):
    """Seeded with the first value; a missing one carries the mean."""
    out, e, a = [], np.nan, 2 / (span + 1)
    for v in x:
        e = e if np.isnan(v) else v if np.isnan(e) else a * v + (1 - a) * e
        out.append(e)
    return np.array(out)


def macd():
    line, signal = np.full((2, T, S), np.nan)
    for t in range(T):
        for s in range(S):
            x = C[max(0, t - 129) : t + 1, s]
            gap = ewm(x, 12) - ewm(x, 26)
            line[t, s], signal[t, s] = gap[-1], gap[-1] - ewm(gap, 9)[-1]
    return line, signal


def streak(c):
    out = np.zeros((T, S))
    for t in range(T):
        out[t] = np.where(c[t], (out[t - 1] if t else 0) + 1, 0)
    return np.minimum(out, 10)


def share_below(x, w, start):
    def one(v):
        n = (~np.isnan(v)).sum()
        return (sum(v <= v[-1]) - 1) / max(n - 1, 1) if not np.isnan(v[-1]) and n >= max(2, w // 2) else np.nan

    return np.where(np.arange(T)[:, None] >= start, np.array([[one(v) for v in row] for row in frames(x, w)]), np.nan)


def since_peak(v):
    return 0.0 if np.isnan(v).any() or not v[-1] < v.max() else len(v) - 1 - int(np.argmax(v))


def new_highs(v):
    v = v[~np.isnan(v)]
    return sum(v[i] > v[:i].max() for i in range(1, len(v)))


def first_run(v):
    best = now = 0
    for up in v > 0:
        now += up
        if now > best:
            best = now
        else:
            now = 0
    return best / len(v)


def tail(v):
    n = np.sort(v[v < 0])
    return -n[max(0, int(np.ceil(0.05 * len(n))) - 1)] if len(n) >= max(1, len(v) // 2) else np.nan


def up_down(v):
    up, down = v[v > 0], -v[v < 0]
    return up.mean() / max(down.mean(), 1e-6) if len(up) and len(down) else np.nan


def autocorr(x, w):
    m = lambda v: mean(v, w - 1, w - 1)
    y = lag(x)
    var = lambda v: np.maximum(m(v * v) - m(v) ** 2, 0)
    den = np.sqrt(var(x) * var(y))
    return div(m(x * y) - m(x) * m(y), np.where(den > 0, den, np.nan))


def moments(x, w):
    m = [mean(x**p, w) for p in (1, 2, 3, 4)]
    var = np.maximum(m[1] - m[0] ** 2, 1e-15)
    third = m[2] - 3 * m[0] * m[1] + 2 * m[0] ** 3
    fourth = m[3] - 4 * m[0] * m[2] + 6 * m[0] ** 2 * m[1] - 3 * m[0] ** 4
    return fourth / var**2, third / var**1.5


R = {p: pct(C, p) for p in (1, 3, 5, 10, 20, 40, 60, 120)}
UP = R[1] > 0
GAP, SPREAD = div(O, lag(C)) - 1, div(H - L, C)
quarter = lambda *x: 0.25 * sum(x)


def momentum():
    intraday, z20 = div(C, O) - 1, zs(C, 20)
    out = {f"factor_mom_ret_{p}d": R[p] for p in R} | {f"factor_mom_voladj_{p}d": R[p] / (sd(R[1], max(p, 5)) + EPS) for p in R}
    out |= {f"factor_rev_ret_{p}d": -R[p] for p in (1, 3, 5)} | {f"factor_rev_volrev_{p}d": -R[p] * rank(V) for p in (1, 3)} | {f"factor_rev_zscore_{p}d": -z20 for p in (1, 3, 5)}
    out |= {"factor_rev_overnight_1d": -GAP, "factor_rev_overnight_5d": -mean(GAP, 5), "factor_rev_intraday_1d": -intraday, "factor_rev_intraday_5d": -mean(intraday, 5)}
    out |= {"factor_rev_gap_1d": -GAP * np.nan_to_num(z20), "factor_rev_range_rev": -(H - L) / (C + EPS), "factor_rev_turnover_1d": -R[1] * rank(TO)}
    return out | {"factor_rev_composite": -quarter(R[1], GAP, intraday, R[1] * rank(V))}


def volatility():
    r, hl, co = R[1], np.log(H / L), np.log(C / O)
    out = {f"factor_vol_realized_{p}d": sd(r, p) for p in (5, 10, 20, 60)} | {f"factor_vol_downside_{p}d": np.sqrt(abs(mean(np.where(r < 0, r, 0), p))) for p in (5, 10, 20, 60)}
    out |= {"factor_vol_of_vol_20d": sd(sd(r, 5), 20), "factor_vol_of_vol_60d": sd(sd(r, 20), 60), "factor_vol_trend_20d": sd(r, 20) / sd(r, 60) - 1, "factor_vol_trend_60d": sd(r, 60) / sd(r, 120) - 1}
    out |= {f"factor_vol_parkinson_{p}d": np.sqrt(abs(mean(hl**2 / (4 * np.log(2)), p))) for p in (5, 20)}
    out |= {"factor_vol_gk_5d": np.sqrt(abs(mean(0.5 * hl**2 - (2 * np.log(2) - 1) * co**2, 5))), "factor_vol_range_20d": mean(H / L - 1, 20)}
    position, direction, efficiency = (C - L) / (H - L), (C - O) / (H - L), GAP / (SPREAD + 1e-6)
    for p in (5, 20):
        out |= {f"factor_intra_ret_mean_{p}d": mean(C / O - 1, p), f"factor_intra_overnight_gap_{p}d": mean(GAP, p), f"factor_intra_close_position_{p}d": mean(position, p)}
        out |= {f"factor_intra_open_position_{p}d": mean((O - L) / (H - L), p), f"factor_intra_hl_vol_{p}d": sd(hl, p)}
    out |= {f"factor_intra_hl_range_{p}d": mean(SPREAD, p) for p in (5, 20, 60)}
    out |= {"factor_intra_directionality_5d": mean(direction, 5), "factor_intra_directionality_std_5d": sd(direction, 5), "factor_intra_gap_efficiency_5d": mean(efficiency, 5)}
    return out | {"factor_intra_composite": quarter(mean(position, 5), mean(direction, 5), -mean(SPREAD, 5), mean(efficiency, 5))}


def liquidity():
    out = {f"factor_liq_turnover_{p}d": mean(TO, p) for p in (5, 10, 20, 60)} | {f"factor_liq_turnover_chg_{p}d": div(TO, mean(TO, p)) - 1 for p in (5, 10, 20, 60)}
    out |= {f"factor_liq_volume_chg_{p}d": div(V, mean(V, p)) - 1 for p in (5, 20)} | {f"factor_liq_amihud_{p}d": mean(div(abs(R[1]), V), p) for p in (5, 20)}
    out |= {"factor_liq_dollar_vol": np.log(C * V), "factor_liq_dollar_vol_chg": pct(C * V, 20), "factor_liq_turnover_vol_20d": sd(TO, 20), "factor_liq_composite": -mean(div(abs(R[1]), V), 20) - sd(TO, 20)}
    out |= {"factor_size_log_mcap": -np.log(MC), "factor_size_cs_rank": rank(MC), "factor_size_quintile": rank(MC), "factor_size_mcap_sqrt": -np.sqrt(MC), "factor_size_mcap_cube_root": -np.cbrt(MC), "factor_size_price": np.log(MC / C)}
    out |= {f"factor_size_mcap_chg_{p}d": pct(MC, p) for p in (5, 20, 60)} | {f"factor_size_mcap_mom_{p}d": pct(MC, p) for p in (5, 20)} | {f"factor_size_mcap_vol_{p}d": sd(pct(MC), p) for p in (20, 60)}
    out |= {"factor_size_small_and_rising": -np.log(MC) * pct(MC, 20), "factor_size_composite": quarter(-np.log(MC), rank(MC), sd(pct(MC), 20), np.log(MC / C))}
    return out | {"factor_size_residual_ret": residual(R[20], MC)}


def value():
    dist = {p: -(div(C, mean(C, p)) - 1) for p in (20, 60, 120)}
    fall = {p: div(C, high(C, p)) - 1 for p in (60, 120)}
    plain = lambda fn: roll(fn, C, 60, start=0)
    out = {"factor_val_inv_price": 1 / C, "factor_val_log_mcap": -np.log(MC), "factor_val_mcap_to_price": MC / C, "factor_val_turnover_yield": 1 / TO}
    out |= {f"factor_val_dist_ma_{p}d": dist[p] for p in dist} | {f"factor_val_dd_{p}d": fall[p] for p in fall}
    out |= {"factor_val_sharpe_inv": -(C - plain(lambda f: np.nanmean(f, 2))) / plain(lambda f: np.nanstd(f, 2, ddof=1)), "factor_val_composite_short": (1 / C + dist[20] + fall[60]) / 3}
    out |= {"factor_val_composite_long": (dist[60] + dist[120] + fall[120]) / 3, "factor_val_inv_price_neut": residual(1 / C, MC), "factor_val_dist_ma_60d_neut": residual(dist[60], MC)}
    return out | {"factor_val_cheap_low_turn": dist[60] - z(TO), "factor_val_price_to_range": -div(C - low(C, 120), high(C, 120) - low(C, 120))}


def quality_merged():
    r, out = R[1], {}
    for p in (20, 60, 120):
        out |= {f"factor_qb_ret_stability_{p}d": 1 / sd(r, p), f"factor_qb_sharpe_{p}d": mean(r, p) / sd(r, p), f"factor_qb_pos_days_{p}d": flags(UP, p) / p}
    out |= {"factor_qb_stability_decay": sd(r, 120) / sd(r, 20), "factor_qb_sharpe_decay": div(out["factor_qb_sharpe_20d"], out["factor_qb_sharpe_120d"])}
    out |= {f"factor_qb_amp_stability_{p}d": 1 / sd(SPREAD, p) for p in (20, 60)} | {f"factor_qb_maxdd_{p}d": div(C, high(C, p)) - 1 for p in (60, 120)}
    out["factor_qb_composite"] = quarter(*(out[f"factor_qb_{n}_60d"] for n in ("sharpe", "pos_days", "maxdd", "ret_stability")))
    out |= {f"factor_qa_ddd_{p}d": each(since_peak, C, p) for p in (60, 120)} | {"factor_qa_consec_sign_change_60d": roll(lambda f: abs(np.diff(f, axis=2)).sum(2) / 60, UP.astype(float), 60, False)}
    by_cap, by_volume = z(residual(C, MC)), z(residual(R[20], V))
    out |= {"factor_cs_momentum_5d": z(R[5]), "factor_cs_momentum_20d": z(R[20]), "factor_cs_close_zscore": z(C), "factor_cs_close_neut_mcap": by_cap, "factor_cs_ret_neut_volume": by_volume}
    return out | {"factor_cs_composite": quarter(z(R[20]), z(C), by_cap, by_volume)}


def quality_pa():
    r, out = R[1], {f"factor_qa_hl_stability_{p}d": 1 / sd(H / L - 1, p) for p in (20, 60)}
    for p in (60, 120):
        out[f"factor_qa_kurt_{p}d"], out[f"factor_qa_skew_{p}d"] = moments(r, p)
        out[f"factor_qa_tail_risk_{p}d"] = each(tail, r, p)
    out |= {"factor_qa_max_consec_pos_60d": each(first_run, r, 60), "factor_qa_up_down_60d": each(up_down, r, 60)}
    out["factor_qa_composite"] = (out["factor_qa_skew_60d"] + out["factor_qa_up_down_60d"]) / 2
    return out | {f"factor_qa_autocorr_{p}d": autocorr(r, p) for p in (20, 60)}


def trend_cs():
    out = {f"factor_trend_ma_{p}d": div(C, mean(C, p)) - 1 for p in (5, 10, 20, 60, 120)} | {f"factor_trend_ma_cross_{a}_{b}": mean(C, a) / mean(C, b) - 1 for a, b in ((5, 20), (10, 60), (20, 120))}
    out["factor_trend_macd"], out["factor_trend_macd_signal"] = macd()
    channel = {p: div(C - low(C, p), high(C, p) - low(C, p)) for p in (20, 60)}
    out |= {f"factor_trend_channel_{p}d": channel[p] for p in channel} | {f"factor_trend_mom_strength_{p}d": zs(C, p) for p in (20, 60)} | {f"factor_cs_rank_zscore_{p}d": zs(C, p) for p in (5, 20, 60)}
    confirm = out["factor_trend_ma_20d"] * z(V)
    out |= {"factor_trend_vol_confirm": confirm, "factor_trend_composite": quarter(out["factor_trend_macd_signal"], channel[20], zs(C, 20), confirm)}
    out |= {"factor_cs_rank_close": rank(C), "factor_cs_rank_volume": rank(V)} | {f"factor_cs_rank_delta_{p}d": rank(C) - lag(rank(C), p) for p in (5, 20, 60)}
    return out | {f"factor_cs_ret_rank_{p}d": rank(R[p]) for p in (1, 20)}


def counting():
    r, before = R[1], lag(R[1])
    out = {f"factor_cnt_countpos_{p}d": flags(r > 0, p) for p in (10, 60)} | {f"factor_cnt_countneg_{p}d": flags(r < 0, p) for p in (10, 60)}
    out |= {"factor_cnt_consec_up_10d": streak(r > 0), "factor_cnt_consec_down_10d": streak(r < 0)}
    same = (r > 0) & (before > 0) | (r < 0) & (before < 0)
    for p in (20, 60):
        out |= {f"factor_cnt_run_pct_{p}d": flags(same, p) / p, f"factor_cnt_tillnow_ret_{p}d": roll(lambda f: np.prod(np.nan_to_num(1 + f, nan=1.0), 2) - 1, r, p, False)}
        out |= {f"factor_cnt_tillnow_dd_{p}d": each(lambda v: np.nan if np.isnan(v).any() else (v / np.maximum.accumulate(v)).min() - 1, C, p)}
        out |= {f"factor_cnt_turnover_rank_chg_{p}d": mean(abs(rank(TO) - lag(rank(TO))), p), f"factor_cnt_new_high_{p}d": each(new_highs, C, p)}
    return out | {"factor_cnt_new_low_60d": each(new_highs, -C, 60)}


def interaction():
    out = {f"factor_inter_ret_vol_{p}d": R[p] * rank(V) for p in (1, 5)} | {f"factor_inter_ret_turnover_{p}d": R[p] * rank(TO) for p in (1, 20)} | {f"factor_inter_ret_mcap_{p}d": R[p] * rank(MC) for p in (5, 20)}
    out |= {f"factor_inter_vol_mcap_{p}d": sd(R[1], p) * rank(MC) for p in (20, 60)} | {"factor_inter_hl_vol_1d": SPREAD * rank(V), "factor_inter_hl_vol_5d": SPREAD * rank(V) * np.nan_to_num(R[5])}
    out |= {f"factor_inter_direction_range_{p}d": np.sign(R[p]) * SPREAD for p in (5, 20)} | {f"factor_inter_to_chg_ret_{p}d": pct(TO, p) * R[p] for p in (5, 20)} | {"factor_inter_mom_vol_conflict": R[20] * sd(R[1], 20)}
    return out | {"factor_inter_composite": quarter(*(out[f"factor_inter_{n}"] for n in ("ret_vol_5d", "ret_mcap_20d", "direction_range_5d", "to_chg_ret_5d")))}


def precision():
    dev, rat, step = (C - VW) / VW, C / VW, VW - lag(VW)
    out = {"factor_cv_dev_inst": dev, "factor_cv_corr_60d": np.full((T, S), np.nan)}
    over = lambda a, b: div(a, np.where(b > EPS, b, np.nan))
    for p in (5, 20):
        out |= {f"factor_vwap_ret_{p}d": pct(VW, p), f"factor_vwap_deviation_{p}d": VW / mean(VW, p) - 1, f"factor_cv_dev_diff_{p}d": dev - lag(dev, p)}
        out[f"factor_cv_dev_accel_{p}d"] = over(mean(dev - lag(dev) - (lag(dev) - lag(dev, 2)), p), sd(dev, p))
        out[f"factor_cv_corr_{p}d"] = over(mean((C - mean(C, p)) * (VW - mean(VW, p)), p), sd(C, p) * sd(VW, p))
        cross = np.vstack([np.full((1, S), np.nan), abs(np.diff((C > VW).astype(float), axis=0))])
        out[f"factor_cv_cross_freq_{p}d"] = mean(cross, p)
        for s in (1, 2, 5):
            out[f"factor_grad_accel_{p}d_s{s}"] = div(mean(C - lag(C, s) + 0 * lag(C, 2 * s), p), sd(VW, p))
    for p in (5, 20, 60):
        out |= {f"factor_grad_momentum_{p}d": mean(step, p) / mean(VW, p), f"factor_cv_dev_mean_{p}d": mean(dev, p), f"factor_cv_dev_std_{p}d": sd(dev, p), f"factor_cv_dev_zscore_{p}d": zs(dev, p, EPS)}
        out |= {f"factor_cv_above_ratio_{p}d": flags(C > VW, p) / p, f"factor_cv_ratio_ma_{p}d": mean(rat, p), f"factor_cv_ratio_reversal_{p}d": rat - mean(rat, p), f"factor_cv_dev_cumsum_{p}d": mean(dev, p) * p}
    return out


def tspct():
    sources = {"open": O, "high": H, "low": L, "close": C, "volume": V, "turnover": TO, "on": div(O - lag(C), lag(C)), "id": div(C - O, O)}
    return {f"factor_tspct_{n}_{p}d": share_below(x, p, 59) for n, x in sources.items() for p in (5, 20, 60)}


def valuation():
    y = {"ep": 1 / PE, "bp": 1 / PB, "sp": 1 / PS, "cfp": 1 / PCF}
    out = {f"factor_est_{n}_1d": y[n] for n in y}
    for n in ("ep", "bp"):
        out |= {f"factor_est_{n}_ma{p}": div(y[n], mean(y[n], p)) - 1 for p in (20, 60)} | {f"factor_est_{n}_zscore_{p}d": zs(y[n], p) for p in (60, 120)} | {f"factor_est_{n}_tspct_{p}d": share_below(y[n], p, p - 1) for p in (60, 120)}
        out |= {f"factor_est_{n}_chg_20d": div(y[n], lag(y[n], 20)) - 1, f"factor_est_{n}_rank": rank(y[n]), f"factor_est_{n}_vol_60d": sd(y[n], 60)}
    roe = div(y["ep"], y["bp"])
    out |= {"factor_est_composite_2": (zs(y["ep"], 60) + zs(y["bp"], 60)) / 2, "factor_est_composite_4": sum(zs(v, 60) for v in y.values()) / 4, "factor_est_spread": rank(y["ep"]) - rank(y["bp"])}
    out |= {"factor_est_cheap_quality": zs(y["ep"], 60) * (1 - z(sd(R[1], 20))), "factor_est_value_momentum": rank(y["ep"]) * rank(R[20])}
    out |= {"factor_est_roe": roe, "factor_est_roe_chg_20d": div(roe, lag(roe, 20)) - 1, "factor_est_roe_zscore_60d": zs(roe, 60)}
    return out | {f"factor_est_{n}_tspct_60d": 1 - share_below(x, 60, 59) for n, x in (("pe", PE), ("pb", PB))}


PLAIN = (momentum, volatility, liquidity, value, quality_merged, quality_pa, trend_cs, counting, interaction, precision, tspct, valuation)


@pytest.fixture(scope="module")
def market(spark):
    first = dt.date(2020, 1, 1)
    rows = [(first + dt.timedelta(days=t), f"c{s}", t, True, *(None if np.isnan(v := DATA[n][t, s]) else float(v) for n in COLUMNS)) for t in range(T) for s in range(S)]
    return spark.createDataFrame(rows, "key date, code string, day_idx int, present boolean, " + ", ".join(f"{n} double" for n in COLUMNS)).cache()


@pytest.mark.parametrize("plain", PLAIN, ids=lambda f: f.__name__)
def test_module(market, plain):
    module = factors.MODULES[plain.__name__]
    k = Kernels("spark", module.window)
    got = k.apply(market, module.columns(k), ("day_idx", "code")).toPandas().sort_values(["day_idx", "code"])
    want = plain()
    assert set(want) == set(got.columns) - {"day_idx", "code"}
    for name, x in want.items():
        y = got[name].to_numpy(float).reshape(T, S)[module.first - 1 :]
        x = x[module.first - 1 :]
        assert np.array_equal(np.isnan(x), np.isnan(y)), name
        assert np.allclose(x, y, rtol=1e-6, atol=1e-9, equal_nan=True), (name, np.nanmax(abs(x - y)))
