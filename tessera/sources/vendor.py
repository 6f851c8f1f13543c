"""Ingest of daily bars: types, derived attributes, price limits, suspended days, completeness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.panel import finite

#: Columns of a bar that are whole numbers; what can't be read counts as 0.
INTEGERS = {"volume": "bigint", "adjustflag": "tinyint", "tradestatus": "tinyint", "isST": "tinyint"}
REALS = ("open", "high", "low", "close", "preclose", "amount", "turn", "pctChg", "peTTM", "pbMRQ", "psTTM", "pcfNcfTTM")
# Boards by the beginning of a code, and their daily limits in per cent.
MAIN_BOARD, GROWTH_BOARD = ("sh.60", "sz.00"), ("sh.68", "sz.30")
MAIN_LIMIT, ST_LIMIT, GROWTH_LIMIT = 9.9, 4.9, 19.9
FILLED = ("open", "high", "low", "close", "volume")


def typed(bars: DataFrame) -> DataFrame:
    """Text columns as numbers; unreadable reals are missing, unreadable integers 0."""
    out = {c: F.coalesce(F.expr(f"try_cast(try_cast({c} as double) as {kind})"), F.lit(0).cast(kind)) for c, kind in INTEGERS.items() if c in bars.columns}
    out |= {c: finite(F.expr(f"try_cast({c} as double)")) for c in REALS if c in bars.columns}
    return bars.withColumns(out)


def starts(code: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | code.startswith(p)
    return out


def at_limit(code: Column, change: Column, st: Column) -> Column:
    main, growth = starts(code, MAIN_BOARD), starts(code, GROWTH_BOARD)
    return F.coalesce((main & (F.abs(change) >= F.when(st == 1, ST_LIMIT).otherwise(MAIN_LIMIT))) | (growth & (F.abs(change) >= GROWTH_LIMIT)), F.lit(False))


def derived(bars: DataFrame, precision: int = 2) -> DataFrame:
    """Turnover, adjusted mean price, float capital, rounded price, and no trading at the limits."""
    zero = F.lit(0.0)
    return bars.withColumns({
        "turnover": F.col("turn") / 100,
        "vwap": F.col("amount") / F.nullif(F.col("volume").cast("double"), zero) * (F.col("close") / F.nullif("close_uq", zero)),
        "market_cap": F.col("volume") / F.nullif(F.col("turn") / 100, zero) * F.col("close_uq"),
        "tradestatus": F.when(at_limit(F.col("code"), F.col("pctChg"), F.col("isST")), F.lit(0)).otherwise(F.col("tradestatus")).cast("tinyint"),
        "close_uq": F.bround("close_uq", precision),
    })


def fill_suspended(panel: DataFrame, columns: tuple[str, ...] = FILLED) -> DataFrame:
    """On suspended days the last traded day's values; a day without a row of the code breaks the chain.

    ``panel`` needs ``day_idx``. A code's own value stays where there is nothing to repeat.
    """
    order = Window.partitionBy("code").orderBy("day_idx")
    run = F.sum((F.col("day_idx") - F.lag("day_idx", 1, -2).over(order) > 1).cast("int")).over(order)
    back = Window.partitionBy("code", "_run").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, 0)
    start = Window.partitionBy("code", "_run").orderBy("day_idx")
    own = {}
    for c in columns:
        traded = F.last(F.when((F.col("tradestatus") != 0) | (F.row_number().over(start) == 1), F.col(c)), ignorenulls=True).over(back)
        own[c] = F.when(F.col("tradestatus") == 0, F.coalesce(traded, F.col(c))).otherwise(F.col(c))
    return panel.withColumn("_run", run).withColumns(own).drop("_run")


def with_unadjusted(bars: DataFrame, unadjusted: DataFrame) -> DataFrame:
    """Adjusted bars with the unadjusted close; bars without one keep their row."""
    return bars.join(unadjusted.select("date", "code", "close_uq"), ["date", "code"], "left")


def code_snapshot(rows: DataFrame, key, prefixes: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Codes listed on a day, by prefix, in order, at most so many."""
    out = rows.where(F.col("key") == F.lit(key)).select("code").distinct()
    if prefixes:
        out = out.where(starts(F.col("code"), prefixes))
    return out if most is None else out.orderBy("code").limit(most)


def stock_list(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code").agg(F.min("key").alias("first_seen"), F.max("key").alias("last_seen"))


def year_chunks(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """The range cut at the ends of years; empty if it ends before it starts."""
    return [(max(start, dt.date(y, 1, 1)), min(end, dt.date(y, 12, 31))) for y in range(start.year, end.year + 1)] if start <= end else []


def missing_days(panel: DataFrame, days: DataFrame) -> DataFrame:
    """Per code the calendar days between its first and last day without a row."""
    have = panel.join(days, "key").select("code", "day_idx")
    span = have.groupBy("code").agg(F.min("day_idx").alias("a"), F.max("day_idx").alias("b"))
    want = span.select("code", F.explode(F.sequence("a", "b")).alias("day_idx"))
    return want.join(have, ["code", "day_idx"], "left_anti").join(days, "day_idx").select("code", "key")


def complete(panel: DataFrame, days: DataFrame) -> DataFrame:
    """Per code whether it has a row on each calendar day of its range."""
    have = panel.join(days, "key").groupBy("code").agg(F.count("*").alias("n_rows"), (F.max("day_idx") - F.min("day_idx") + 1).alias("n_days"))
    return have.select("code", "n_rows", "n_days", (F.col("n_rows") >= F.col("n_days")).alias("complete"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("key", "code")) -> DataFrame:
    """Old rows without those that new rows replace, and the new rows (of equal keys one)."""
    newest = new.dropDuplicates(list(keys))
    return old.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest.select(*old.columns))
