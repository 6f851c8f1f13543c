"""Panels, pipelines, sources, sinks, evaluation, models, back-test, optimizer, stream."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tessera.operators import backtest as B
from tessera.operators import models as M
from tessera.operators import optimizer as O
from tessera.operators import signals as S
from tessera.plans.dag import Pipeline, PipelineConfig, columns, merged
from tessera.plans.frame import Panel, as_of_window
from tessera.sources import panel as P
from tessera.sources import sinks, synthetic, vendor

D = [dt.date(2020, 1, d) for d in range(1, 8)]


def panel(spark, cells, schema="key date, code string, close double"):
    return spark.createDataFrame(cells, schema)


def test_constant_single_and_empty(spark):
    p = Panel(panel(spark, [(D[0], "a", 5.0), (D[0], "b", 5.0), (D[1], "a", 5.0)]))
    z = {(r.key, r.code): r.close for r in p.cs_zscore("close").df.collect()}
    assert set(z.values()) == {0.0}
    r = {(r.key, r.code): r.close for r in p.cs_rank("close").df.collect()}
    assert r[D[0], "a"] == 0.5 and r[D[1], "a"] == 0.5
    assert Panel(panel(spark, [])).cs_rank("close").df.count() == 0


def test_nan_and_infinity_are_missing(spark):
    p = Panel(panel(spark, [(D[0], "a", float("nan")), (D[0], "b", float("inf")), (D[0], "c", 1.0)]))
    assert [r.close for r in p.df.orderBy("code").collect()] == [None, None, 1.0]


def test_lag_is_by_calendar(spark):
    p = Panel(panel(spark, [(D[0], "a", 1.0), (D[2], "a", 3.0), (D[0], "b", 1.0), (D[1], "b", 2.0), (D[2], "b", 3.0)]))
    got = {(r.key, r.code): r.close for r in p.ts_delay("close").df.collect()}
    assert got[D[2], "a"] is None and got[D[2], "b"] == 2.0


def test_methods_leave_the_panel_alone(spark):
    p = Panel(panel(spark, [(D[0], "a", 1.0), (D[1], "a", 2.0)]))
    q = p.ts_pct_change("close", [1, 2], prefix="r")
    assert "r_1d" in q.columns and p.columns == ["close"]


def test_neutralize_on_two_columns(spark):
    rng = np.random.default_rng(1)
    cells = [(D[0], f"c{i}", *map(float, rng.normal(size=3))) for i in range(12)]
    p = Panel(panel(spark, cells, "key date, code string, y double, a double, b double"))
    got = p.cs_neutralize("y", ["a", "b"], to="e").df.toPandas().sort_values("code")
    pdf = pd.DataFrame(cells, columns=["key", "code", "y", "a", "b"]).sort_values("code")
    x = ((pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std()).to_numpy()
    beta = np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0]
    assert np.allclose(got["e"], pdf["y"] - x @ beta)


def test_column_checks(spark):
    p = Panel(panel(spark, [(D[0], "a", 1.0)]))
    with pytest.raises(ValueError):
        p.select(keep=["nothing"])
    with pytest.raises(ValueError):
        p.select(keep=["close"], exclude=["close"])
    with pytest.raises(ValueError):
        p.merge(p)
    with pytest.raises(ValueError):
        Panel(spark.createDataFrame([(1,)], "x int"))


def test_merge_needs_equal_rows(spark):
    a = Panel(panel(spark, [(D[0], "a", 1.0)]))
    b = Panel(panel(spark, [(D[0], "b", 1.0)], "key date, code string, x double"))
    with pytest.raises(ValueError):
        a.merge(b)


def test_window_universe(spark):
    cells = [(D[t], "s0", 1.0) for t in range(4)] + [(D[t], "s1", 2.0) for t in range(2, 4)] + [(D[t], "s2", 3.0) for t in range(3)]
    right = as_of_window(panel(spark, cells), 3, 3).collect()
    assert {r.code for r in right} == {"s0", "s1"} and len(right) == 6
    assert [r.close for r in sorted(right, key=lambda r: (r.code, r.day_idx)) if r.code == "s1"] == [None, 2.0, 2.0]
    left = as_of_window(panel(spark, cells), 3, 3, "left").collect()
    assert {r.code for r in left} == {"s0", "s2"}


def test_pipeline_rules(spark):
    rows = panel(spark, [(D[0], "a", 1.0)])
    p = Pipeline()
    p.add_source("src", lambda: rows)
    p.add_node("twice", lambda f: f.selectExpr("key", "code", "close * 2 as twice"), "src")
    p.add_node("sum", lambda f, ctx: f.selectExpr("key", "code", "close + twice as total"), ["src", "twice"], output=["total"])
    assert p.problems() == [] and p.run()["sum"].first().total == 3.0
    assert "sum <- src, twice" in repr(p)
    p.add_node("sum", lambda f: f, "nowhere")
    assert len(p.problems()) == 2
    loop = Pipeline()
    loop.add_node("a", lambda f: f, "b")
    loop.add_node("b", lambda f: f, "a")
    assert "the nodes form a cycle" in loop.problems()
    mixed = Pipeline()
    mixed.add_source("s", lambda: rows)
    mixed.add_node("l", lambda f: f, "s", align="left")
    mixed.add_node("r", lambda f: f, "s")
    mixed.add_node("both", lambda f: f, ["l", "r"])
    assert any("aligned" in x for x in mixed.problems())
    lonely = Pipeline()
    lonely.add_source("s", lambda: rows)
    lonely.add_source("t", lambda: rows)
    assert lonely.problems()
    with pytest.raises(ValueError):
        merged([rows, rows])
    with pytest.raises(ValueError):
        columns(rows, ["x"], None)
    with pytest.raises(ValueError):
        PipelineConfig(fwd=1)


def test_vendor_types_limits_and_fill(spark):
    bars = spark.createDataFrame([("2020-01-01", "sh.600000", "10.5", "", "x", "1")], "date string, code string, close string, volume string, turn string, tradestatus string")
    r = vendor.typed(bars).first()
    assert (r.close, r.volume, r.turn, r.tradestatus) == (10.5, 0, None, 1)
    rows = [("sh.600000", 9.9, 0), ("sh.600000", 4.9, 1), ("sh.600000", 4.9, 0), ("sz.300000", 9.9, 0), ("sz.300000", 19.9, 0), ("sz.300000", None, 0)]
    got = spark.createDataFrame(rows, "code string, p double, st int").select(vendor.at_limit(*map(__import__("pyspark").sql.functions.col, ("code", "p", "st"))).alias("x")).collect()
    assert [r.x for r in got] == [True, True, False, False, True, False]
    fill = spark.createDataFrame([("a", 0, 1.0, 1), ("a", 1, 9.0, 0), ("a", 2, 9.0, 0), ("a", 4, 7.0, 0), ("a", 5, 8.0, 1)], "code string, day_idx int, close double, tradestatus int")
    assert [r.close for r in vendor.fill_suspended(fill, ("close",)).orderBy("day_idx").collect()] == [1.0, 1.0, 1.0, 7.0, 8.0]
    assert vendor.year_chunks(dt.date(2019, 6, 1), dt.date(2020, 2, 1)) == [(dt.date(2019, 6, 1), dt.date(2019, 12, 31)), (dt.date(2020, 1, 1), dt.date(2020, 2, 1))]
    assert vendor.year_chunks(dt.date(2020, 1, 2), dt.date(2020, 1, 1)) == []


def test_upsert_and_sinks(spark, tmp_path):
    old = panel(spark, [(dt.date(2019, 5, 1), "a", 1.0), (dt.date(2020, 5, 1), "a", 2.0)])
    path = str(tmp_path / "panel")
    sinks.write_panel(old, path)
    sinks.upsert_panel(panel(spark, [(dt.date(2020, 5, 1), "a", 3.0), (dt.date(2020, 5, 1), "b", 4.0)]), path)
    got = sorted((r.key.year, r.code, r.close) for r in sinks.read_panel(spark, path).collect())
    assert got == [(2019, "a", 1.0), (2020, "a", 3.0), (2020, "b", 4.0)]
    assert sinks.read_panel(spark, path, start=dt.date(2020, 1, 1)).count() == 2
    sinks.log_metrics(spark, str(tmp_path / "m"), "r", "n", {"a": 1, "b": 2.5}, 3)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_simulator_is_reproducible_and_noise_lowers_the_signal():
    a, b = synthetic.simulate(30, 5, seed=1), synthetic.simulate(30, 5, seed=1)
    pd.testing.assert_frame_equal(a, b)
    assert (a["low"] <= a["close"]).all() and (a["high"] >= a["open"]).all()


def test_lookback(spark):
    rows = panel(spark, [(d, "a", 1.0) for d in D])
    assert P.with_lookback(rows, D[4], 2).count() == 5
    assert P.with_lookback(rows, dt.date(2021, 1, 1), 2).count() == 0


# --- evaluation -------------------------------------------------------------------------------


def test_labels_are_returns_from_the_next_day(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame(10 * np.exp(np.cumsum(rng.normal(0, 0.02, (7, 9)), 0)), index=D, columns=[f"c{i}" for i in range(9)])
    dense = P.densify(panel(spark, [(d, c, float(x.at[d, c])) for d in D for c in x.columns]))
    got = S.labels(dense, 3, 0.01).toPandas().pivot(index="key", columns="code", values="fwd_ret").astype(float)
    want = x.shift(-3) / x.shift(-1) - 1
    assert np.allclose(got.to_numpy()[:4], want.to_numpy()[:4]) and got.iloc[4:].isna().all().all()
    label = S.labels(dense, 3, 0.01).toPandas().pivot(index="key", columns="code", values="label").astype(float)
    assert np.allclose(label.iloc[:4].mean(axis=1), 0) and np.allclose(label.iloc[:4].std(axis=1, ddof=0), 1)


def test_ic_of_a_perfect_and_a_constant_signal(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame(10 * np.exp(np.cumsum(rng.normal(0, 0.02, (7, 9)), 0)), index=D, columns=[f"c{i}" for i in range(9)])
    r = x.shift(-3) / x.shift(-1) - 1
    cells = [(d, c, float(x.at[d, c]), None if np.isnan(r.at[d, c]) else float(r.at[d, c]), 1.0) for d in D for c in x.columns]
    dense = P.densify(panel(spark, cells, "key date, code string, close double, best double, flat double"))
    days = S.information_coefficients(dense, "best", 3).collect()
    assert len(days) == 4 and all(abs(d.pearson_ic - 1) < 1e-9 and abs(d.rank_ic - 1) < 1e-9 for d in days)
    assert all(d.pearson_ic == 0 and d.rank_ic == 0 for d in S.information_coefficients(dense, "flat", 3).collect())
    assert S.ic_summary(S.information_coefficients(dense, "best", 3)).count() == 0


def test_groups(spark):
    rows = spark.createDataFrame([(D[0], f"c{i:02d}", float(i)) for i in range(20)], "key date, code string, pred_signal double")
    got = {r.code: (r.group_id, r.weight) for r in S.groups(rows, 10).collect()}
    assert got["c00"] == (0, 0.5) and got["c19"] == (9, 0.5)
    assert S.groups(rows.limit(5), 10).count() == 0
    ties = spark.createDataFrame([(D[0], f"c{i}", 1.0) for i in range(10)], "key date, code string, pred_signal double")
    assert {r.group_id for r in S.groups(ties, 5).collect()} == {0}


# --- models -----------------------------------------------------------------------------------


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 200) + 3
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, label double")
    model = M.ridge(rows, ["a", "b", "c"], alpha=42.0)
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + 42 * np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(model.weights, want) and np.isclose(model.intercept, y.mean() - x.mean(0) @ want)
    assert M.ridge(rows.limit(10), ["a", "b", "c"]) is None
    assert abs(sum(model.importance().values()) - 1) < 1e-12
    scaled = M.scaled_importance(model.importance())
    assert list(scaled)[0] == "b" and set(scaled.values()) >= {0.0, 1.0}


@pytest.mark.parametrize("loss", M.LOSSES)
def test_loss_gradients(loss):
    rng = np.random.default_rng(5)
    p, y = rng.normal(size=20), rng.normal(size=20)
    value, g, _ = M.LOSSES[loss](p, y)
    for i in range(20):
        q = p.copy()
        q[i] += 1e-6
        assert (M.LOSSES[loss](q, y)[0] - value) / 1e-6 == pytest.approx(g[i], abs=1e-5)


@pytest.mark.parametrize("residual", [False, True])
def test_network_learns(residual):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    y = np.tanh(x[:, 0]) - x[:, 1]
    net = M.Network(sizes=(16, 16), residual=residual, epochs=60, rate=5e-3, seed=1).fit(x, y)
    assert np.corrcoef(net.predict(x), y)[0, 1] > 0.9 and abs(net.importance().sum() - 1) < 1e-9


def test_training_days_leave_out_labels_that_reach_past_the_window():
    for a, b, c, d in M.train_days(200, 60, 5, 20):
        assert b + 5 < c and b - a == 59 + 0 and d - c <= 19
    assert M.time_series_folds(40, 3) == [(10, 10, 19), (20, 20, 29), (30, 30, 39)]


def test_cross_validation_finds_a_planted_signal(spark):
    rng = np.random.default_rng(11)
    cells = [(dt.date(2020, 1, 1) + dt.timedelta(days=t), f"c{i}", t, float(x), float(x + 0.1 * e)) for t in range(40) for i in range(10) for x, e in [rng.normal(size=2)]]
    rows = spark.createDataFrame(cells, "key date, code string, day_idx int, a double, label double")
    got = M.cross_validation(rows, ["a"], 40).orderBy("fold").collect()
    assert [r.n for r in got] == [100, 100, 100] and all(r.rank_ic > 0.9 for r in got)
    assert M.cross_validation(rows, ["a"], 2).count() == 0


def test_usable_rows(spark):
    rows = spark.createDataFrame([(1.0, None, 1.0), (None, None, 1.0), (1.0, 1.0, None)], "a double, b double, label double")
    assert rows.where(M.usable(["a", "b"])).count() == 1


# --- back-test --------------------------------------------------------------------------------

RULES = B.Rules(fwd=2, cash=100_000, slip_ticks=0)


def quotes(**prices):
    return {c: B.Quote(p, p, True) for c, p in prices.items()}


def test_commission_and_split():
    book = B.Book(RULES)
    assert book.commission(1000) == 5.0 and book.commission(1_000_000) == 500.0
    lot = B.Lot(100, 1.0, 2, 0.0)
    assert lot.shares(1.1) == 110 and lot.value(55.0) == 5500 and lot.shares(None) == 0


def test_open_hold_close():
    book = B.Book(RULES)
    book.make_plan(0, quotes(a=10.0), {"a": (1.0, 0.5)})
    book.execute(1, quotes(a=10.0))
    assert book.lots["a", 1].anchor == 5000 and book.cash == 100_000 - 50_000 - 25
    book.plan = []
    book.make_plan(1, quotes(a=10.0), {})
    assert book.plan == []
    book.make_plan(2, quotes(a=11.0), {})
    assert [o.rank for o in book.plan] == [3]
    book.execute(3, quotes(a=11.0))
    assert not book.lots and book.cash == pytest.approx(49_975 + 55_000 - 27.5)


def test_short_of_cash_buys_whole_lots():
    book = B.Book(B.Rules(fwd=1, cash=1_000, slip_ticks=0))
    book.plan = [B.Order(0, 1.0, "a", 2.0, ())]
    book.execute(1, quotes(a=3.0))
    assert book.lots["a", 1].anchor == 300 and book.cash == 1000 - 900 - 5


def test_suspended_and_lost_listings():
    book = B.Book(RULES)
    book.plan = [B.Order(0, 1.0, "a", 1.0, ()), B.Order(0, 0.5, "gone", 1.0, ())]
    book.execute(1, {"a": B.Quote(10.0, 10.0, False)})
    assert not book.lots and [t["note"] for t in book.trades] == ["listing ended", "failed, suspended"]
    book.lots["b", 0] = B.Lot(100, 1.0, 1, 0.0)
    book.plan = [B.Order(3, -100.0, "b", 0.0, (0,))]
    book.execute(2, quotes(a=10.0))
    assert not book.lots


def test_adjust_makes_one_new_lot():
    book = B.Book(B.Rules(fwd=1, cash=10_000, slip_ticks=0))
    book.lots = {("a", 0): B.Lot(100, 1.0, 1, 0.0), ("a", 1): B.Lot(100, 1.0, 2, 0.0)}
    book.make_plan(1, quotes(a=10.0), {"a": (0.5, 1.0)})
    assert [(o.rank, o.lots) for o in book.plan] == [(1, (0, 1))]
    book.execute(2, quotes(a=10.0))
    assert list(book.lots) == [("a", 2)] and book.lots["a", 2].anchor == 600


def test_fees_grow_and_drawdown_is_never_positive(spark):
    rows = synthetic.simulate(40, 10, seed=5)
    days = {k: i for i, k in enumerate(sorted(rows["key"].unique()))}
    market = spark.createDataFrame([(r.key, r.code, days[r.key], r.stock_name, r.close, r.close_uq, 1) for r in rows.itertuples()], "key date, code string, day_idx int, stock_name string, close double, close_uq double, tradestatus int")
    grouped = S.groups(market.selectExpr("key", "code", "close as pred_signal"), 2)
    nav = B.backtest(market, grouped, 2, B.Rules(fwd=4, cash=1e6)).toPandas().sort_values(["group_id", "day_idx"])
    assert len(nav) == 80 and (nav["drawdown"] <= 0).all()
    assert (nav.groupby("group_id")["cumsum_fee"].diff().dropna() >= 0).all()
    out = B.summary(B.backtest(market, grouped, 2, B.Rules(fwd=4, cash=1e6))).toPandas()
    assert len(out) == 2 and (out["n_buys"] > 0).all()


# --- optimizer, stream ------------------------------------------------------------------------


def test_optimizer():
    w = O.project(np.array([0.9, 0.5, -1.0, 0.2]), 0.4)
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= 0.4
    rng = np.random.default_rng(8)
    r = rng.normal(0, 0.01, (100, 20))
    cov = O.factor_covariance(r, 5)
    full = np.cov(r.T)
    x = np.full(20, 0.05)
    assert O.risk(x, cov) == pytest.approx(x @ full @ x, rel=0.5)
    before = np.full(20, 0.05)
    signal = rng.normal(size=20)
    assert (O.allocate(signal, r, before, -0.1) == before).all()
    w = O.allocate(signal, r, before, 0.1, target=10.0, cap=0.2)
    assert w.sum() == pytest.approx(1, abs=1e-6) and np.corrcoef(w, signal)[0, 1] > 0.3


def test_weights_are_handed_on(spark):
    rng = np.random.default_rng(12)
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=t) for t in range(14)]
    ret, signal = rng.normal(0, 0.01, (14, 6)), rng.normal(size=(14, 6))
    rows = [(d, f"c{i}", float(signal[t, i]), float(ret[t, i])) for t, d in enumerate(days) for i in range(6) if (t, i) != (12, 2)]
    df = spark.createDataFrame(rows, "key date, code string, pred_signal double, ret double")
    got = O.allocate_path(df, lookback=10, cap=0.5).toPandas().pivot(index="key", columns="code", values="weight")
    before = dict.fromkeys(range(6), 1 / 6)
    for t in range(9, 14):
        there = [i for i in range(6) if (t, i) != (12, 2)]
        history = ret[t - 9 : t + 1][:, there].copy()
        if 12 in range(t - 9, t + 1) and 2 in there:
            history[12 - (t - 9), there.index(2)] = 0
        w = O.allocate(signal[t, there], history, np.array([before.get(i, 0.0) for i in there]), 0.05, cap=0.5)
        before = dict(zip(there, w))
        assert np.allclose(got.loc[days[t]].dropna(), w)
    assert len(got) == 5
    flat = O.allocate_path(df, lookback=10, mean_ic=0.0).toPandas()
    assert set(flat["weight"].round(9)) <= {round(1 / 6, 9), 0.0}


def test_rolling_ridge_in_one_pass_equals_date_by_date(spark):
    rng = np.random.default_rng(13)
    cells = [(dt.date(2020, 1, 1) + dt.timedelta(days=t), f"c{i}", t, *map(float, rng.normal(size=3))) for t in range(70) for i in range(8)]
    rows = spark.createDataFrame(cells, "key date, code string, day_idx int, a double, b double, label double")
    got = M.rolling_predictions(rows, ["a", "b"], 70, model_window=20, fwd=3, retrain_every=15).toPandas().set_index(["code", "day_idx"])["_pred"]
    x = pd.DataFrame(cells, columns=["key", "code", "t", "a", "b", "y"])
    for first, last, start, stop in M.train_days(70, 20, 3, 15):
        own = x[x["t"].between(first, last)]
        f = own[["a", "b"]].to_numpy() - own[["a", "b"]].to_numpy().mean(0)
        w = np.linalg.solve(f.T @ f + 42 * np.eye(2), f.T @ (own["y"] - own["y"].mean()))
        c = own["y"].mean() - own[["a", "b"]].to_numpy().mean(0) @ w
        for r in x[x["t"].between(start, stop)].itertuples():
            assert got[r.code, r.t] == pytest.approx(c + w @ [r.a, r.b], abs=1e-9)
    assert len(got) == 8 * (70 - 23)


def plain_book(days, prices, members, fwd, cash):
    """The rules in short for prices without splits or suspensions: net asset value per day."""
    lots, plan, nav = {}, [], []
    fee = lambda v: round(max(v * 0.0005, 5.0), 2)
    for t in range(days):
        worth = lambda t=t: round(cash + sum(n * prices[t][c] for (c, _), (n, _) in lots.items()), 2)
        part = worth() / fwd
        for rank, _, c, old in plan:
            p = prices[t][c]
            each = [lots.pop((c, b))[0] for b in old]
            held = sum(each)
            if rank == 3:
                cash += sum(n * (p - 0.01) - fee(n * (p - 0.01)) for n in each)
                continue
            want = round(part * members[t - 1][c][0] / (p + 0.01 if rank == 0 else p) / 100) * 100
            change = want - held
            if change > 0:
                paid = next((n for n in (change, min(change, int(max(0, cash - 5) / (p + 0.01) / 100) * 100)) if n > 0 and cash >= n * (p + 0.01) + fee(n * (p + 0.01))), 0)
                if paid:
                    cash -= paid * (p + 0.01) + fee(paid * (p + 0.01))
                held += paid
            elif change < 0:
                cash += -change * (p - 0.01) - fee(-change * (p - 0.01))
                held += change
            if held > 0:
                lots[c, t] = (held, t + fwd)
        nav.append(worth())
        part = worth() / fwd
        due = {}
        for (c, b), (_, until) in lots.items():
            if until <= t + 1:
                due.setdefault(c, []).append(b)
        plan = []
        for c, own in due.items():
            if c not in members[t]:
                plan.append((3, -100.0, c, own))
            else:
                change = round(part * members[t][c][0], 2) - round(sum(lots[c, b][0] for b in own) * prices[t][c], 2)
                if abs(change) >= 1:
                    plan.append((2 if change < 0 else 1, members[t][c][1], c, own))
        plan += [(0, s, c, []) for c, (_, s) in members[t].items() if c not in due]
        plan.sort(key=lambda o: (-o[0], -o[1], o[2]))
    return nav


def test_books_against_a_plain_loop(spark):
    rng = np.random.default_rng(14)
    codes = [f"c{i}" for i in range(9)]
    price = np.round(10 * np.exp(np.cumsum(rng.normal(0, 0.02, (30, 9)), 0)), 2)
    signal = rng.normal(size=(30, 9))
    start = dt.date(2021, 1, 1)
    rows = [(start + dt.timedelta(days=t), c, t, c, float(price[t, i]), float(price[t, i]), 1, float(signal[t, i])) for t in range(30) for i, c in enumerate(codes)]
    market = spark.createDataFrame(rows, "key date, code string, day_idx int, stock_name string, close double, close_uq double, tradestatus int, pred_signal double")
    grouped = S.groups(market.select("key", "code", "pred_signal"), 3)
    nav = B.backtest(market.drop("pred_signal"), grouped, 3, B.Rules(fwd=3, cash=1e6)).toPandas().pivot(index="day_idx", columns="group_id", values="value")
    for g in range(3):
        members = []
        for t in range(30):
            order = np.argsort(np.argsort(signal[t]))
            own = [i for i in range(9) if order[i] // 3 == g]
            members.append({codes[i]: (1 / len(own), float(signal[t, i])) for i in own})
        want = plain_book(30, [dict(zip(codes, map(float, p))) for p in price], members, 3, 1e6)
        assert np.allclose(nav[g], want, atol=0.02), (g, nav[g].to_numpy() - want)


def test_stream_equals_batch(spark, tmp_path):
    from functools import partial

    from tessera.streaming.rows import replay, row_window

    rng = np.random.default_rng(9)
    cells = [(d, c, None if (d, c) == (D[1], "a") else float(rng.normal())) for d in D for c in ("a", "b")]
    for i, d in enumerate(D):
        panel(spark, [x for x in cells if x[0] == d]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    schema = "key date, code string, close double"
    out = replay(spark, str(tmp_path / "in" / "*"), schema, partial(row_window, rows=3), str(tmp_path / "out"), str(tmp_path / "state"), files_at_once=100)
    got = out.toPandas().pivot(index="key", columns="code", values="mean")
    want = pd.DataFrame(cells, columns=["key", "code", "close"]).pivot(index="key", columns="code", values="close").rolling(3, min_periods=1).mean()
    assert np.allclose(got.to_numpy(), want.to_numpy())
