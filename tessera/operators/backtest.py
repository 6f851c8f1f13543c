"""Grouped long-only back-test: overlapping books that hold each day's signal group for ``fwd`` days.

A group's book depends on its own past only, so groups run side by side, each as one pass over rows
sorted by day that holds its book and one day of the market; a group gets the rows of a code from the
day on which the code first had its signal. What feeds the books (groups of the signal) and what reads
them (summaries) are plain aggregates. Shares are anchored: ``shares / factor`` is constant through
splits, where factor = adjusted / unadjusted close.

A day: yesterday's plan is executed at today's close (lost listings, then sales, reductions,
additions, openings; suspended codes are logged and tried again later), the book is valued, and
a plan is made from today's group. Trades are in lots of 100, at a price moved against the trade by
``slip_ticks`` ticks, with a commission of at least ``min_commission``; what cash does not cover is
cut down to the lots it does. Money is rounded half to even.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TICK, LOT = 0.01, 100


@dataclass(frozen=True)
class Rules:
    fwd: int = 20
    cash: float = 1e8
    commission_rate: float = 0.0005
    min_commission: float = 5.0
    slip_ticks: int = 1
    precision: int = 2


@dataclass
class Lot:
    anchor: float  # shares on the day of buying
    factor: float  # adjustment factor on that day
    due: int
    signal: float

    def shares(self, factor: float | None) -> float:
        return 0.0 if not factor or self.factor <= 0 else float(round(self.anchor * factor / self.factor))

    def value(self, adjusted: float | None) -> float:
        return 0.0 if not adjusted or adjusted <= 0 or self.factor <= 0 else self.anchor * adjusted / self.factor


@dataclass(frozen=True)
class Quote:
    price: float
    adjusted: float
    trades: bool
    name: str = ""

    @property
    def factor(self) -> float | None:
        return self.adjusted / self.price if self.price > 0 and self.adjusted > 0 else None


@dataclass(frozen=True)
class Order:
    rank: int  # 3 close, 2 reduce, 1 add, 0 open: larger ones first
    signal: float
    code: str
    weight: float
    lots: tuple[int, ...]  # days on which the lots were bought


KINDS = {3: "close", 2: "reduce", 1: "add", 0: "open"}


@dataclass
class Book:
    rules: Rules
    cash: float = 0.0
    lots: dict[tuple[str, int], Lot] = field(default_factory=dict)
    fees: float = 0.0
    peak: float = 1.0
    plan: list[Order] = field(default_factory=list)
    trades: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.cash = self.rules.cash

    def commission(self, value: float) -> float:
        return round(max(abs(value) * self.rules.commission_rate, self.rules.min_commission), self.rules.precision)

    def equity(self, market: dict[str, Quote]) -> float:
        held = sum(lot.value(market[code].adjusted if code in market else None) for (code, _), lot in self.lots.items())
        return round(self.cash + held, self.rules.precision)

    def _log(self, day: int, code: str, kind: str, action: str, shares: float, price: float, value: float, fee: float, signal: float, note: str) -> None:
        self.trades.append({"day": day, "code": code, "kind": kind, "action": action, "shares": float(shares), "price": float(price), "value": float(value), "commission": float(fee), "signal": float(signal), "note": note})

    def buy(self, day: int, order: Order, kind: str, shares: float, price: float) -> float:
        """Buy up to ``shares``; the shares that were bought."""
        wanted = shares
        for note in ("done", "partly, short of cash"):
            value = shares * price
            fee = self.commission(value)
            if shares > 0 and self.cash >= value + fee:
                self.cash -= value + fee
                self._log(day, order.code, kind, "buy", shares, price, value, fee, order.signal, note)
                return shares
            shares = min(wanted, math.floor(max(0.0, self.cash - self.rules.min_commission) / price / LOT) * LOT)
        self._log(day, order.code, kind, "buy", shares, price, 0.0, 0.0, order.signal, "failed, short of cash")
        return 0.0

    def sell(self, day: int, order: Order, kind: str, shares: float, price: float) -> None:
        value = shares * price
        fee = self.commission(value)
        self.cash += value - fee
        self._log(day, order.code, kind, "sell", shares, price, value, fee, order.signal, "done")

    def execute(self, day: int, market: dict[str, Quote]) -> None:
        slice_value = max(self.equity(market), 1.0) / self.rules.fwd
        slip = self.rules.slip_ticks * TICK
        for order in (o for o in self.plan if o.code not in market):
            for bought in order.lots:
                lot = self.lots.pop((order.code, bought))
                self._log(day, order.code, "delist", "sell", lot.anchor, 0.0, 0.0, 0.0, order.signal, "listing ended")
            if not order.lots:
                self._log(day, order.code, "delist", "buy", 0, 0.0, 0.0, 0.0, order.signal, "listing ended")
        for order in (o for o in self.plan if o.code in market):
            quote, kind = market[order.code], KINDS[order.rank]
            action = "sell" if order.rank >= 2 else "buy"
            if not quote.trades:
                self._log(day, order.code, kind, action, 0, quote.price, 0.0, 0.0, order.signal, "failed, suspended")
                continue
            old = [self.lots[order.code, b] for b in order.lots]
            held = sum(lot.shares(quote.factor) for lot in old)
            target = slice_value * order.weight
            if order.rank == 3:
                for bought, lot in zip(order.lots, old):
                    shares = lot.shares(quote.factor)
                    if shares > 0:
                        self.sell(day, order, kind, shares, quote.price - slip)
                    else:
                        self._log(day, order.code, kind, "sell", shares, quote.price - slip, 0.0, 0.0, order.signal, "failed, no shares")
                    del self.lots[order.code, bought]
                continue
            if order.rank == 0:
                price = quote.price + slip
                shares = round(target / price / LOT) * LOT
                left = self.buy(day, order, kind, shares, price) if shares > 0 else 0.0
            else:
                change = round(target / quote.price / LOT) * LOT - held
                left = held
                if change > 0:
                    left += self.buy(day, order, kind, change, quote.price + slip)
                elif change < 0:
                    self.sell(day, order, kind, min(-change, held), quote.price - slip)
                    left -= min(-change, held)
                for bought in order.lots:
                    del self.lots[order.code, bought]
            if left > 0 and quote.factor:
                self.lots[order.code, day] = Lot(left, quote.factor, day + self.rules.fwd, order.signal)

    def make_plan(self, day: int, market: dict[str, Quote], signal: dict[str, tuple[float, float]]) -> None:
        """Orders for the next day; ``signal`` maps code to (weight, signal)."""
        due: dict[str, list[int]] = {}
        for (code, bought), lot in self.lots.items():
            if lot.due <= day + 1:
                due.setdefault(code, []).append(bought)
        slice_value = max(self.equity(market), 1.0) / self.rules.fwd
        orders = []
        for code, lots in due.items():
            if code not in signal:
                orders.append(Order(3, -100.0, code, 0.0, tuple(lots)))
                continue
            weight, value = signal[code]
            adjusted = market[code].adjusted if code in market else None
            now = round(sum(self.lots[code, b].value(adjusted) for b in lots), self.rules.precision)
            change = round(slice_value * weight, self.rules.precision) - now
            if abs(change) >= 1.0:
                orders.append(Order(2 if change < 0 else 1, value, code, weight, tuple(lots)))
        orders += [Order(0, value, code, weight, ()) for code, (weight, value) in signal.items() if code not in due]
        self.plan = sorted(orders, key=lambda o: (-o.rank, -o.signal, o.code))

    def value_row(self, day: int, market: dict[str, Quote]) -> dict:
        now = [t for t in self.trades if t["day"] == day]
        self.fees += sum(t["commission"] for t in now)
        total = self.equity(market)
        nav = total / self.rules.cash if self.rules.cash > 0 else 0.0
        self.peak = max(self.peak, nav)
        moved = sum(t["value"] for t in now)
        return {
            "day_idx": day, "cash": round(self.cash, self.rules.precision), "value": total, "nav": nav, "peak_nav": self.peak, "drawdown": (nav - self.peak) / self.peak if self.peak > 0 else 0.0,
            "cumsum_fee": round(self.fees, self.rules.precision), "n_positions": len(self.lots), "turnover": round(moved / total, 6) if total > 0 else 0.0,
            "n_buys": sum(t["action"] == "buy" and t["commission"] > 0 and t["value"] > 0 for t in now), "n_sells": sum(t["action"] == "sell" and t["commission"] > 0 and t["value"] > 0 for t in now),
        }


#: Columns of a row of a day, as ``run_day`` takes them.
SIDES = ["code", "close_uq", "close", "tradestatus", "stock_name", "weight", "pred_signal"]


def run_day(book: Book, day: int, rows: list[tuple]) -> dict:
    """One day of a book; ``rows`` (``SIDES``, by code) have the market and, where weight is set, the group's signal."""
    market = {c: Quote(float(p), float(a), bool(t), n) for c, p, a, t, n, _, _ in rows}
    signal = {c: (float(w), float(s)) for c, _, _, _, _, w, s in rows if pd.notna(w)}
    book.execute(day, market)
    book.plan = []
    out = book.value_row(day, market)
    book.make_plan(day, market, signal)
    return out


def days_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, object, list[tuple]]]:
    """(group, day, key, rows) from batches sorted by group and day; a day may go over several batches."""
    at, key, held = None, None, []
    for batch in batches:
        sides = zip(*(batch[c].tolist() for c in SIDES))
        for group, day, k, row in zip(batch["group_id"].tolist(), batch["day_idx"].tolist(), batch["key"].tolist(), sides):
            if (group, day) != at:
                if at is not None:
                    yield int(at[0]), int(at[1]), key, held
                at, key, held = (group, day), k, []
            if row[0] is not None:  # a row without a code stands for the day
                held.append(row)
    if at is not None:
        yield int(at[0]), int(at[1]), key, held


ROWS_AT_ONCE = 1_000
NAV_SCHEMA = "group_id int, key date, day_idx bigint, cash double, value double, nav double, peak_nav double, drawdown double, cumsum_fee double, n_positions bigint, turnover double, n_buys bigint, n_sells bigint"
TRADE_SCHEMA = "group_id int, day bigint, code string, kind string, action string, shares double, price double, value double, commission double, signal double, note string"


def market_by_group(panel: DataFrame, grouped: DataFrame, num_groups: int) -> DataFrame:
    """Per group and day the rows of codes that have had the group's signal, sorted, with the signal
    where it has one; and a row without a code, so that every group has every day."""
    sides = panel.select("key", "code", "day_idx", "stock_name", "close", "close_uq", "tradestatus").where("close is not null and close_uq is not null")
    signal = grouped.select("key", "code", F.col("group_id").alias("own"), "weight", "pred_signal")
    until_now = Window.partitionBy("code").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    each = sides.join(signal, ["key", "code"], "left").withColumn("seen", F.collect_set("own").over(until_now))
    each = each.withColumn("group_id", F.explode("seen")).drop("seen")
    mine = F.col("own") == F.col("group_id")
    each = each.withColumns({"weight": F.when(mine, F.col("weight")), "pred_signal": F.when(mine, F.col("pred_signal"))}).drop("own")
    every = sides.select("key", "day_idx").distinct().withColumn("group_id", F.explode(F.sequence(F.lit(0), F.lit(num_groups - 1))))
    both = each.unionByName(every, allowMissingColumns=True)
    return both.repartition("group_id").sortWithinPartitions("group_id", "day_idx", "code")


def backtest(panel: DataFrame, grouped: DataFrame, num_groups: int, rules: Rules) -> DataFrame:
    """A row per group and day: cash, value, nav, drawdown, fees, positions, turnover."""
    names = [c.split()[0] for c in NAV_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, book, out = None, Book(rules), []
        for group, day, key, rows in days_of(batches):
            if group != last:
                last, book = group, Book(rules)
            out.append(run_day(book, day, rows) | {"key": key, "group_id": group})
            book.trades.clear()
            if len(out) == ROWS_AT_ONCE:
                yield pd.DataFrame(out)[names]
                out = []
        yield pd.DataFrame(out, columns=names)

    return market_by_group(panel, grouped, num_groups).mapInPandas(run, NAV_SCHEMA)


def trade_log(panel: DataFrame, grouped: DataFrame, num_groups: int, rules: Rules) -> DataFrame:
    names = [c.split()[0] for c in TRADE_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, book, out = None, Book(rules), []
        for group, day, _, rows in days_of(batches):
            if group != last:
                last, book = group, Book(rules)
            run_day(book, day, rows)
            out += [t | {"group_id": group} for t in book.trades]
            book.trades.clear()
            if len(out) >= ROWS_AT_ONCE:
                yield pd.DataFrame(out)[names]
                out = []
        yield pd.DataFrame(out, columns=names)

    return market_by_group(panel, grouped, num_groups).mapInPandas(run, TRADE_SCHEMA)


def summary(nav: DataFrame) -> DataFrame:
    """Per group: return, yearly return and deviations, Sharpe ratio, deepest fall, turnover, trades."""
    w = Window.partitionBy("group_id").orderBy("day_idx")
    daily = nav.withColumn("_r", F.col("nav") / F.nullif(F.lag("nav").over(w), F.lit(0.0)) - 1)
    total = F.max_by("nav", "day_idx") - 1
    yearly, spread = total * 252 / F.count("*"), F.stddev_pop("_r") * math.sqrt(252)
    return daily.groupBy("group_id").agg(
        total.alias("total_return"), yearly.alias("annual_return"), spread.alias("annual_volatility"), (yearly / F.nullif(spread, F.lit(0.0))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("mean_turnover"), F.sum("n_buys").alias("n_buys"), F.sum("n_sells").alias("n_sells"),
    )
