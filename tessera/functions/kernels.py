"""Kernels over a dense panel, as SQL text for Spark or DuckDB.

A dense panel has the columns ``code``, ``key``, ``day_idx`` (position of the day in the calendar),
``present`` (the code has a row on that day) and attributes, with one row per code and day between
a code's first and last day. ``Kernels`` collects windowed expressions as named nodes; ``stages``
orders them so that all expressions over time that can be computed come before any over a day. Spark
then sorts once per (code, day) and once per day for each turn, and not once per expression.

Expressions are plain text, so the text that Spark runs can be held against the same formula on
another engine. The two dialects differ in list functions, quantiles and lambdas; and recursions that
start anew with every row's window, which SQL folds over a list for each row, run in Spark as numpy code
over the rows of a code (``recursive``), all those of a stage in one pass over Arrow batches.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions import recursive

#: Fewest rows per unit of window that a rolling kernel needs.
HALF = 2
EPS = "1e-8"
_NODE = re.compile(r"\bn\d+_\b")


class Kernels:
    def __init__(self, dialect: str = "spark", rows: int = 130):
        self.spark, self.rows = dialect == "spark", rows
        self.nodes: dict[str, tuple[str, str]] = {}  # name: (over "time", "day" or "rows", SQL)
        self._named: dict[str, str] = {}
        self._calls: dict[str, tuple[str, str, tuple, int]] = {}  # nodes over "rows": function, SQL of its values, arguments, result

    # --- nodes -------------------------------------------------------------------------------

    def node(self, over: str, sql: str) -> str:
        """The name of a column that holds ``sql``; equal text shares a column."""
        if sql not in self._named:
            self._named[sql] = name = f"n{len(self.nodes)}_"
            self.nodes[name] = (over, sql)
        return self._named[sql]

    def stages(self, wanted: list[str] | None = None) -> list[list[str]]:
        """Lists of nodes whose inputs are in earlier lists; only those that ``wanted`` texts need."""
        need: set[str] = set()
        todo = [n for text in (self.nodes if wanted is None else wanted) for n in _NODE.findall(text)]
        while todo:
            name = todo.pop()
            if name not in need:
                need.add(name)
                todo += _NODE.findall(self.nodes[name][1])
        out: list[list[str]] = []
        done: set[str] = set()
        over = "rows"
        while len(done) < len(need):
            ready = [n for n in self.nodes if n in need and n not in done and done.issuperset(_NODE.findall(self.nodes[n][1]))]
            kinds = {self.nodes[n][0] for n in ready}
            over = over if over in kinds else next(o for o in ("rows", "time", "day") if o in kinds)
            out.append([n for n in ready if self.nodes[n][0] == over])
            done.update(out[-1])
        return out

    def call(self, function: str, x: str, *args: object, result: int = 0) -> str:
        """The name of a column that holds a result of a recursion over the rows of a code."""
        name = self.node("rows", f"{function}[{result}]{args!r} of {x}")
        self._calls[name] = (function, x, args, result)
        return name

    def _recurse(self, panel: DataFrame, names: list[str]) -> DataFrame:
        """``panel`` with the results of recursions, in one pass over the rows of each code."""
        inputs = list(dict.fromkeys(self._calls[n][1] for n in names))
        calls = [(f, inputs.index(x), args, result) for f, x, args, result in (self._calls[n] for n in names)]
        at, width = panel.columns.index("day_idx"), len(panel.columns)

        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column(at).to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            day = table.column(at).to_numpy()
            values = [table.column(width + i).cast(pa.float64()).to_numpy() for i in range(len(inputs))]
            known: dict = {}
            out = table.select(range(width))
            for name, (f, x, args, result) in zip(names, calls):
                if (f, x, args) not in known:
                    more = (day,) if f == "share_below" else ()
                    known[f, x, args] = getattr(recursive, f)(values[x], *args, *more)
                got = known[f, x, args][result]
                out = out.append_column(name, pa.array(got, pa.float64(), from_pandas=True))  # NaN is missing
            return out

        schema = StructType([*panel.schema.fields, *(StructField(n, DoubleType()) for n in names)])
        rows = panel.selectExpr("*", *(f"cast({x} as double) as x{i}_" for i, x in enumerate(inputs)))
        return rows.groupBy("code").applyInArrow(run, schema)

    def apply(self, panel: DataFrame, outputs: dict[str, str], keep: tuple[str, ...] = ("key", "code")) -> DataFrame:
        """``keep`` and ``outputs`` computed over a dense panel, for present rows."""
        for stage in self.stages(list(outputs.values())):
            if self.nodes[stage[0]][0] == "rows":
                panel = self._recurse(panel, stage)
            else:
                panel = panel.selectExpr("*", *(f"{self.nodes[n][1]} as {n}" for n in stage))
        return panel.where("present").select(*keep, *(F.expr(sql).alias(name) for name, sql in outputs.items()))

    def query(self, source: str, outputs: dict[str, str], keep: tuple[str, ...] = ("key", "code"), where: str = "present") -> str:
        """The same as one SQL query over ``source``, a query that gives a dense panel."""
        parts = [f"s0 as ({source})"]
        for k, stage in enumerate(self.stages(list(outputs.values()))):
            parts.append(f"s{k + 1} as (select *, " + ", ".join(f"{self.nodes[n][1]} as {n}" for n in stage) + f" from s{k})")
        return "with " + ",\n".join(parts) + "\nselect " + ", ".join([*keep, *(f"{sql} as {name}" for name, sql in outputs.items())]) + f"\nfrom s{len(parts) - 1} where {where}"

    # --- frames ------------------------------------------------------------------------------

    @staticmethod
    def _w(n: int) -> str:
        return f"(partition by code order by day_idx rows between {n - 1} preceding and current row)"

    def time(self, sql: str) -> str:
        return self.node("time", sql)

    def day(self, sql: str) -> str:
        return self.node("day", sql)

    # --- rows before -------------------------------------------------------------------------

    def lag(self, x: str, n: int = 1) -> str:
        return self.time(f"lag({x}, {n}) over (partition by code order by day_idx)")

    def lead(self, x: str, n: int = 1) -> str:
        return self.time(f"lead({x}, {n}) over (partition by code order by day_idx)")

    def pct(self, x: str, n: int = 1) -> str:
        before = self.lag(x, n)
        return f"(({x} - {before}) / nullif({before}, 0))"

    # --- rolling kernels: full frame by the calendar, and half of the values -------------------

    def _full(self, x: str, n: int, value: str, start: int | None = None) -> str:
        return self.time(f"case when day_idx >= {n - 1 if start is None else start} and count({x}) over {self._w(n)} >= {max(1, n // HALF)} then {value} over {self._w(n)} end")

    def mean(self, x: str, n: int, start: int | None = None) -> str:
        return self._full(x, n, f"avg({x})", start)

    def std(self, x: str, n: int) -> str:
        """Population standard deviation."""
        return self._full(x, n, f"stddev_pop({x})")

    def sum(self, x: str, n: int) -> str:
        return self._full(x, n, f"sum({x})")

    def min(self, x: str, n: int) -> str:
        return self.time(f"case when day_idx >= {n - 1} then min({x}) over {self._w(n)} end")

    def max(self, x: str, n: int) -> str:
        return self.time(f"case when day_idx >= {n - 1} then max({x}) over {self._w(n)} end")

    def flags(self, condition: str, n: int) -> str:
        """Number of rows of the full frame where the condition holds; missing counts as no."""
        return self.time(f"case when day_idx >= {n - 1} then sum(case when {condition} then 1e0 else 0e0 end) over {self._w(n)} end")

    def share(self, condition: str, n: int) -> str:
        return f"({self.flags(condition, n)} / {n})"

    def zscore(self, x: str, n: int, least: str = "0") -> str:
        sd = self.std(x, n)
        return f"(({x} - {self.mean(x, n)}) / case when {sd} > {least} then {sd} end)"

    def expanding(self, x: str, n: int, fn: str) -> str:
        """Rolling from the first row on, with half of the window's values at least."""
        return self.time(f"case when count({x}) over {self._w(n)} >= {max(1, n // HALF)} then {fn}({x}) over {self._w(n)} end")

    def moment(self, x: str, n: int, kind: str) -> str:
        """Bias-corrected skewness or excess kurtosis over what the frame has, from half of it on."""
        w, least = self._w(n), max(1, n // HALF, 3 if kind == "skew" else 4)
        c = f"(count({x}) over {w})"
        if not self.spark:
            value = f"{'skewness' if kind == 'skew' else 'kurtosis'}({x}) over {w}"
        elif kind == "skew":
            value = f"(skewness({x}) over {w}) * sqrt({c} * ({c} - 1e0)) / ({c} - 2)"
        else:
            value = f"({c} - 1e0) / (({c} - 2) * ({c} - 3)) * (({c} + 1) * (kurtosis({x}) over {w}) + 6)"
        return self.time(f"case when {c} >= {least} then {value} end")

    def ts_rank(self, x: str, n: int) -> str:
        """(mean rank of the last value - 1) / (rows of the frame - 1); needs two values."""
        values, size = self._list(x, n), "size" if self.spark else "len"
        count = lambda op: f"{size}({f'filter({values}, e -> e {op} {x})' if self.spark else f'list_filter({values}, lambda e: e {op} {x})'})"
        rows = f"(count(*) over {self._w(n)})"
        return self.time(f"case when {x} is not null and {size}({values}) >= 2 then ({count('<')} + ({count('=')} + 1) / 2e0 - 1) / ({rows} - 1) end")

    def ewm_adjusted(self, x: str, span: int, least: int, n: int) -> str:
        """Exponential mean with weights that sum to 1 over the values seen, over ``n`` rows at most."""
        if self.spark:
            return self.call("ewm_adjusted", x, span, least, n)
        a = 2 / (span + 1)
        step = {"u": f"case when v is null then {1 - a!r} * a.u else {1 - a!r} * a.u + v end", "d": f"case when v is null then {1 - a!r} * a.d else {1 - a!r} * a.d + 1 end"}
        fold = self._fold(self._rows(x, n), {"u": "0e0", "d": "0e0"}, step, "a.u / nullif(a.d, 0)", missing=True)
        return self.time(f"case when count({x}) over {self._w(n)} >= {least} then {fold} end")

    # --- lists over a frame --------------------------------------------------------------------

    def _list(self, x: str, n: int) -> str:
        """The values of the frame in order, without missing ones."""
        return self.time(f"collect_list({x}) over {self._w(n)}" if self.spark else f"list({x}) filter (where {x} is not null) over {self._w(n)}")

    def _rows(self, x: str, n: int) -> str:
        """The values of the frame in order, missing ones too: as structs of ``v`` in Spark."""
        return self.time(f"collect_list(struct({x} as v)) over {self._w(n)}" if self.spark else f"list({x}) over {self._w(n)}")

    def _fold(self, values: str, start: dict[str, str], step: dict[str, str], out: str, missing: bool = False) -> str:
        """Fold a list with a struct; ``a`` is the state and ``v`` the value in the texts."""
        if self.spark:
            v = "e.v" if missing else "e"
            names = lambda d: "named_struct(" + ", ".join(f"'{k}', {t}" for k, t in d.items()) + ")"
            put = {k: re.sub(r"\bv\b", v, t) for k, t in step.items()}
            return f"aggregate({values}, {names(start)}, (a, e) -> {names(put)}, a -> {out})"
        # each value becomes a state with the value in it, so that states fold with states
        names = lambda d, v: "{" + ", ".join(f"'{k}': {t}" for k, t in [*d.items(), ("v", v)]) + "}"
        put = {k: re.sub(r"\bv\b", "e.v", t) for k, t in step.items()}
        states = f"list_transform({values}, lambda q: {names(start, 'q')})"
        folded = f"list_reduce(list_prepend({names(start, 'null::double')}, {states}), lambda a, e: {names(put, 'null::double')})"
        return "(" + re.sub(r"\ba\.", f"{folded}.", out) + ")"

    def ewm(self, x: str, span: int) -> str:
        """Exponential mean, seeded with the first value among the last ``rows`` rows."""
        if self.spark:
            return self.call("ewm", x, span, self.rows)
        a = 2 / (span + 1)
        step = {"e": f"case when v is null then a.e when a.e is null then v else {a!r} * v + {1 - a!r} * a.e end"}
        return self.time(self._fold(self._rows(x, self.rows), {"e": "cast(null as double)"}, step, "a.e", missing=True))

    def macd(self, x: str, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[str, str]:
        """MACD and its distance to its own exponential mean, all seeded at the first row of the node's window."""
        if self.spark:
            return tuple(self.call("macd", x, fast, slow, signal, self.rows, result=i) for i in (0, 1))
        f, s, g = (2 / (n + 1) for n in (fast, slow, signal))
        null = "cast(null as double)"
        up = lambda k, a: f"(case when a.{k} is null then v else {a!r} * v + {1 - a!r} * a.{k} end)"
        gap = f"({up('xf', f)} - {up('xs', s)})"
        step = {
            "xf": f"case when v is null then a.xf else {up('xf', f)} end",
            "xs": f"case when v is null then a.xs else {up('xs', s)} end",
            # a missing value repeats the last gap, which the signal takes in once more
            "xg": f"case when v is null then case when a.xf is null then a.xg else {g!r} * (a.xf - a.xs) + {1 - g!r} * a.xg end "
            f"when a.xg is null then {gap} else {g!r} * {gap} + {1 - g!r} * a.xg end",
        }
        rows = self._rows(x, self.rows)
        start = dict.fromkeys(step, null)
        return self.time(self._fold(rows, start, step, "a.xf - a.xs", missing=True)), self.time(self._fold(rows, start, step, "a.xf - a.xs - a.xg", missing=True))

    def rank_pct(self, x: str, n: int, start: int) -> str:
        """(values up to the last one - 1) / (values - 1) in the frame, from row ``start`` on."""
        if self.spark:
            return self.call("share_below", x, max(2, n // HALF), start, n)
        values, size = self._list(x, n), "size" if self.spark else "len"
        keep = f"filter({values}, e -> e <= {x})" if self.spark else f"list_filter({values}, lambda e: e <= {x})"
        return self.time(f"case when day_idx >= {start} and {x} is not null and {size}({values}) >= {max(2, n // HALF)} then ({size}({keep}) - 1e0) / greatest({size}({values}) - 1, 1) end")

    def tail_risk(self, x: str, n: int) -> str:
        """Minus the 5 % smallest of the negative values; needs half of the frame negative."""
        low = f"case when {x} < 0 then {x} end"
        values = self._list(f"({low})", n)
        size, sort = ("size", "array_sort") if self.spark else ("len", "list_sort")
        at = f"cast(greatest(1, ceil(0.05e0 * {size}({values}))) as int)"
        item = f"element_at({sort}({values}), {at})" if self.spark else f"({sort}({values}))[{at}]"
        return self.time(f"case when day_idx >= {n - 1} and {size}({values}) >= {max(1, n // HALF)} then -{item} end")

    def since_peak(self, x: str, n: int) -> str:
        """Rows since the first maximum of the frame; 0 at it, and where a value is missing."""
        values, top = self._list(x, n), self.max(x, n)
        at, size = ("array_position", "size") if self.spark else ("list_position", "len")
        return self.time(f"case when day_idx < {n - 1} then null when {size}({values}) < {n} or not {x} < {top} then 0e0 else {n}e0 - {at}({values}, {top}) end")

    def new_highs(self, x: str, n: int) -> str:
        """Number of strict new maxima after the first value."""
        fold = self._fold(self._list(x, n), {"b": "cast(null as double)", "c": "-1"}, {"b": "coalesce(greatest(a.b, v), v)", "c": "case when a.b is null or v > a.b then a.c + 1 else a.c end"}, "a.c")
        return self.time(f"case when day_idx >= {n - 1} then cast(greatest({fold}, 0) as double) end")

    def drawdown(self, x: str, n: int) -> str:
        """Smallest value / running maximum - 1 in the frame; missing if a value is."""
        top = "greatest(a.m, v)"
        size = "size" if self.spark else "len"
        values = self._list(x, n)
        fold = self._fold(values, {"m": "cast('-Infinity' as double)", "d": "0e0"}, {"m": top, "d": f"least(a.d, v / case when {top} = 0 then 1e0 else {top} end - 1)"}, "a.d")
        return self.time(f"case when day_idx >= {n - 1} and {size}({values}) = {n} then {fold} end")

    def first_run(self, condition: str, n: int) -> str:
        """Length of the frame's first run of rows where the condition holds, over the frame's length."""
        values = self._list(f"(case when {condition} then 1e0 else 0e0 end)", n)
        fold = self._fold(values, {"c": "0e0", "b": "0e0"}, {"c": "case when a.c + v > a.b then a.c + v else 0e0 end", "b": "greatest(a.b, a.c + v)"}, "a.b")
        return self.time(f"case when day_idx >= {n - 1} then {fold} / {n} end")

    # --- counts and products ---------------------------------------------------------------------

    def streak(self, condition: str, cap: int = 10) -> str:
        """Length of the run of rows up to this one where the condition holds, at most ``cap``."""
        w = self._w(cap + 1)
        return self.time(f"cast(least({cap}, day_idx - coalesce(max(case when {condition} then null else day_idx end) over {w}, min(day_idx) over {w} - 1)) as double)")

    def flips(self, condition: str, n: int) -> str:
        """Changes of the condition between rows of the frame, over the frame's length."""
        flag = f"(case when {condition} then 1e0 else 0e0 end)"
        change = self.time(f"abs({flag} - coalesce(lag({flag}, 1) over (partition by code order by day_idx), 0e0))")
        return self.time(f"case when day_idx >= {n - 1} then sum({change}) over {self._w(n - 1)} / {n} end")

    def growth(self, r: str, n: int) -> str:
        return self.time(f"case when day_idx >= {n - 1} then product(coalesce(1 + {r}, 1e0)) over {self._w(n)} - 1 end") if not self.spark else self.time(
            f"case when day_idx >= {n - 1} then aggregate(collect_list(coalesce(1 + {r}, 1e0)) over {self._w(n)}, 1e0, (a, e) -> a * e) - 1 end"
        )

    def up_down(self, r: str, n: int) -> str:
        up = self.time(f"case when day_idx >= {n - 1} then avg(case when {r} > 0 then {r} end) over {self._w(n)} end")
        down = self.time(f"case when day_idx >= {n - 1} then avg(case when {r} < 0 then -{r} end) over {self._w(n)} end")
        return f"case when {up} is not null and {down} is not null then {up} / greatest({down}, 1e-6) end"

    def autocorr(self, x: str, n: int) -> str:
        """Lag-1 correlation of the pairs in the frame, each mean over its own values."""
        y = self.lag(x)
        m = lambda v: self.mean(v, n - 1, n - 1)
        cov = f"({m(f'({x} * {y})')} - {m(x)} * {m(y)})"
        var = lambda v: f"greatest({m(f'({v} * {v})')} - {m(v)} * {m(v)}, 0)"
        den = self.time(f"sqrt({var(x)} * {var(y)})")
        return f"({cov} / case when {den} > 0 then {den} end)"

    def moments(self, x: str, n: int) -> tuple[str, str]:
        """Kurtosis (not excess) and skewness of the frame, variance at least 1e-15."""
        m1, m2, m3, m4 = (self.mean(x if p == 1 else f"({x}{f' * {x}' * (p - 1)})", n) for p in (1, 2, 3, 4))
        var = f"greatest({m2} - {m1} * {m1}, 1e-15)"
        mu3 = f"({m3} - 3 * {m1} * {m2} + 2 * {m1} * {m1} * {m1})"
        mu4 = f"({m4} - 4 * {m1} * {m3} + 6 * {m1} * {m1} * {m2} - 3 * {m1} * {m1} * {m1} * {m1})"
        known = f"{m4} is not null"
        return f"case when {known} then {mu4} / ({var} * {var}) end", f"case when {known} then {mu3} / ({var} * sqrt({var})) end"

    # --- cross-sections over the codes of a day ----------------------------------------------------

    _D = "(partition by key, present)"

    def cs_z(self, x: str) -> str:
        """z-score with the sample deviation; 0 where it is undefined."""
        return self.day(f"coalesce(({x} - avg({x}) over {self._D}) / nullif(stddev_samp({x}) over {self._D}, 0), 0e0)")

    def cs_z_pop(self, x: str) -> str:
        """z-score with the population deviation; missing stays, no spread gives 0."""
        sd = self.day(f"stddev_pop({x}) over {self._D}")
        mu = self.day(f"avg({x}) over {self._D}")
        return f"case when {x} is null then null when {sd} = 0 then 0e0 else ({x} - {mu}) / {sd} end"

    def cs_demean(self, x: str) -> str:
        return self.day(f"{x} - avg({x}) over {self._D}")

    def cs_rank(self, x: str) -> str:
        """(mean rank - 1) / (rows - 1); rows count missing values; one row gives 0.5."""
        order = f"(partition by key, present order by {x} nulls last"
        mean_rank = f"(rank() over {order}) + (count(*) over {order} range between current row and current row) - 1) / 2e0)"
        return self.day(f"case when {x} is null then null when count(*) over {self._D} <= 1 then 0.5e0 else ({mean_rank} - 1) / (count(*) over {self._D} - 1) end")

    def cs_residual(self, y: str, by: str) -> str:
        """Residual of y on the z-score of ``by``, without intercept; y - mean below three values."""
        z = self.cs_z(by)
        beta = self.day(f"coalesce(sum({z} * {y}) over {self._D} / nullif(sum(case when {y} is not null then {z} * {z} end) over {self._D}, 0), 0e0)")
        return self.day(f"case when count({y}) over {self._D} < 3 then {y} - avg({y}) over {self._D} else {y} - {z} * {beta} end")

    def quantiles(self, x: str, low: float, high: float) -> tuple[str, str]:
        """Two quantiles of a day, by linear interpolation."""
        if self.spark:
            q = self.day(f"percentile({x}, array({low!r}, {high!r})) over {self._D}")
            return f"{q}[0]", f"{q}[1]"
        q = self.day(f"quantile_cont({x}, [{low!r}, {high!r}]) over {self._D}")
        return f"{q}[1]", f"{q}[2]"

    def cs_z_trimmed(self, x: str, trim: float = 0.01) -> str:
        """z-score by the mean and deviation of what lies between the quantiles; 0 where undefined."""
        low, high = self.quantiles(x, trim, 1 - trim)
        n = self.day(f"count({x}) over {self._D}")
        # a quantile between equal values may be off by rounding
        inner = f"case when {n} < {1 / trim!r} or ({x} >= {low} - 1e-9 * abs({low}) and {x} <= {high} + 1e-9 * abs({high})) then {x} end"
        mu, sd = self.day(f"avg({inner}) over {self._D}"), self.day(f"stddev_samp({inner}) over {self._D}")
        return f"coalesce(({x} - {mu}) / nullif({sd}, 0), 0e0)"

    def hold(self, sql: str, over: str = "time") -> str:
        """A column of its own for a text that is used often."""
        return self.node(over, sql)
