"""``Panel``: a lazy (key, code) table with methods over time and over the codes of a day.

Every method gives a new panel; nothing runs until rows are asked for. The panel is dense inside
(see ``sources.panel.densify``), so a lag is a lag of calendar rows, and only real rows come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.kernels import Kernels
from tessera.sources.panel import clean, densify

_OWN = ("code", "key", "day_idx", "present")


class Panel:
    def __init__(self, df: DataFrame, dense: bool = False):
        missing = {"key", "code"} - set(df.columns)
        if missing:
            raise ValueError(f"a panel needs the columns {sorted(missing)}")
        if len({c.lower() for c in df.columns}) < len(df.columns):
            raise ValueError(f"columns appear twice: {sorted(df.columns)}")
        self._dense = df if dense else densify(clean(df))

    @property
    def dense(self) -> DataFrame:
        return self._dense

    @property
    def df(self) -> DataFrame:
        """The real rows: key, code and attributes."""
        return self._dense.where("present").select("key", "code", *self.columns)

    @property
    def columns(self) -> list[str]:
        return [c for c in self._dense.columns if c not in _OWN]

    def _new(self, df: DataFrame) -> Panel:
        return Panel(df, dense=True)

    def with_kernels(self, build: Callable[[Kernels], dict[str, str]]) -> Panel:
        """Add (or replace) columns by kernel expressions."""
        k = Kernels()
        out = build(k)
        df = self._dense
        for stage in k.stages(list(out.values())):
            df = df.selectExpr("*", *(f"{k.nodes[n][1]} as {n}" for n in stage))
        kept = [c for c in self._dense.columns if c not in out]
        return self._new(df.select(*kept, *(F.expr(sql).alias(c) for c, sql in out.items())))

    # over time
    def ts_delay(self, col: str, n: int = 1, to: str | None = None) -> Panel:
        return self.with_kernels(lambda k: {to or col: k.lag(col, n)})

    def ts_delta(self, col: str, n: int = 1, to: str | None = None) -> Panel:
        return self.with_kernels(lambda k: {to or col: f"{col} - {k.lag(col, n)}"})

    def ts_pct_change(self, col: str, periods: int | Iterable[int] = 1, prefix: str | None = None) -> Panel:
        if isinstance(periods, int):
            return self.with_kernels(lambda k: {col if prefix is None else f"{prefix}_{periods}d": k.pct(col, periods)})
        return self.with_kernels(lambda k: {f"{prefix or col}_{p}d": k.pct(col, p) for p in periods})

    def ts_rolling(self, col: str, window: int, fn: str = "mean", to: str | None = None) -> Panel:
        names = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}
        if fn in ("skew", "kurt"):
            return self.with_kernels(lambda k: {to or col: k.moment(col, window, fn)})
        return self.with_kernels(lambda k: {to or col: k.expanding(col, window, names[fn])})

    def ts_zscore(self, col: str, window: int, to: str | None = None) -> Panel:
        return self.with_kernels(lambda k: {to or col: f"({col} - {k.expanding(col, window, 'avg')}) / nullif({k.expanding(col, window, 'stddev_samp')}, 0)"})

    def ts_rank(self, col: str, window: int, to: str | None = None) -> Panel:
        return self.with_kernels(lambda k: {to or col: k.ts_rank(col, window)})

    # over the codes of a day
    def cs_zscore(self, cols: str | list[str]) -> Panel:
        return self.with_kernels(lambda k: {c: k.cs_z(c) for c in ([cols] if isinstance(cols, str) else cols)})

    def cs_zscore_trimmed(self, cols: str | list[str], trim: float = 0.01) -> Panel:
        return self.with_kernels(lambda k: {c: k.cs_z_trimmed(c, trim) for c in ([cols] if isinstance(cols, str) else cols)})

    def cs_rank(self, cols: str | list[str]) -> Panel:
        return self.with_kernels(lambda k: {c: k.cs_rank(c) for c in ([cols] if isinstance(cols, str) else cols)})

    def cs_demean(self, col: str, to: str | None = None) -> Panel:
        return self.with_kernels(lambda k: {to or col: k.cs_demean(col)})

    def cs_neutralize(self, col: str, by: str | list[str], to: str | None = None) -> Panel:
        """Residual on the z-scores of ``by``, which stay in the panel as z-scores."""
        by = [by] if isinstance(by, str) else by
        if len(by) == 1:
            return self.with_kernels(lambda k: {by[0]: k.cs_z(by[0]), to or col: k.cs_residual(col, by[0])})
        return self.cs_zscore(by)._neutralize_many(col, by, to or col)

    def _neutralize_many(self, col: str, by: list[str], to: str) -> Panel:
        """Several regressors: one small least-squares problem per day, on the day's codes."""
        import numpy as np

        schema = T.StructType([*self._dense.schema.fields, T.StructField("_out", T.DoubleType())])
        least = max(3, len(by) + 2)

        def solve(pdf):
            y = pdf[col].to_numpy(float)
            ok = pdf["present"].to_numpy(bool) & ~np.isnan(y)
            out = np.full(len(y), np.nan)
            if ok.sum() >= least:
                x = pdf[by].to_numpy(float)
                beta = np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
                out[ok] = y[ok] - x[ok] @ beta
            elif ok.any():
                out[ok] = y[ok] - y[ok].mean()
            return pdf.assign(_out=out)

        df = self._dense.groupBy("key").applyInPandas(solve, schema)
        df = df.withColumn("_out", F.when(~F.isnan("_out"), F.col("_out")))
        return self._new(df.withColumn(to, F.col("_out")).drop("_out"))

    # rows and columns
    def select(self, keep: list[str] | None = None, exclude: list[str] | None = None) -> Panel:
        """Keep or drop columns; text columns always stay. Unknown or contradictory names raise."""
        text = [f.name for f in self._dense.schema.fields if isinstance(f.dataType, T.StringType) and f.name != "code"]
        unknown = (set(keep or ()) | set(exclude or ())) - set(self.columns)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        if set(keep or ()) & set(exclude or ()):
            raise ValueError(f"columns both kept and dropped: {sorted(set(keep) & set(exclude))}")
        names = [c for c in self.columns if (keep is None or c in keep or c in text) and c not in (exclude or ())]
        return self._new(self._dense.select(*_OWN, *names))

    def filter_codes(self, mask: DataFrame) -> Panel:
        """Codes for which ``mask(code, keep)`` is true."""
        return self._new(self._dense.join(mask.where("keep").select("code").distinct(), "code", "left_semi"))

    def add_column(self, name: str, values: DataFrame) -> Panel:
        """Join ``values(key, code, name)`` by (key, code); absent cells are missing."""
        return self._new(self._dense.drop(name).join(values.select("key", "code", name), ["key", "code"], "left"))

    def cast_floats(self, kind: str = "float") -> Panel:
        return self._new(self._dense.withColumns({f.name: F.col(f.name).cast(kind) for f in self._dense.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}))

    def at_key(self, key) -> DataFrame:
        return self.df.where(F.col("key") == F.lit(key))

    def of_code(self, code: str) -> DataFrame:
        return self.df.where(F.col("code") == code)

    def last_frame(self) -> DataFrame:
        return self.df.join(self.df.agg(F.max("key").alias("key")), "key", "left_semi")

    def first_frame(self) -> DataFrame:
        return self.df.join(self.df.agg(F.min("key").alias("key")), "key", "left_semi")

    def factor_columns(self) -> list[str]:
        """Numeric columns that a model can use: not ``close`` and not private."""
        return [f.name for f in self._dense.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in ("close", *_OWN) and not f.name.startswith("_")]

    def merge(self, other: Panel) -> Panel:
        """Columns of two panels with the same (key, code) rows; other rows or columns raise."""
        twice = set(self.columns) & set(other.columns) - {"stock_name"}
        if twice:
            raise ValueError(f"columns appear twice: {sorted(twice)}")
        a, b = self.df.select("key", "code", F.lit(1).alias("_a")), other.df.select("key", "code", F.lit(1).alias("_b"))
        if not a.join(b, ["key", "code"], "full_outer").where("_a is null or _b is null").isEmpty():
            raise ValueError("the panels have different rows")
        extra = [c for c in other.columns if c not in self.columns]
        return self._new(self._dense.join(other._dense.select("key", "code", *extra), ["key", "code"], "left"))

    def describe(self) -> DataFrame:
        """Rows, days, codes, and the share of valid cells of the numeric columns."""
        names = [f.name for f in self._dense.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in _OWN]
        valid = sum((F.count(c) for c in names), F.lit(0))
        return self.df.agg(
            F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_days"), F.countDistinct("code").alias("n_codes"), (valid / (F.count("*") * max(1, len(names)))).alias("valid")
        )


def as_of_window(panel: DataFrame, day_idx: int, window: int, align: str = "right") -> DataFrame:
    """The window of ``window`` days up to ``day_idx``: all its days x the codes of its newest day
    (``right``) or oldest day (``left``); absent cells are missing, other codes are left out."""
    from tessera.sources.panel import calendar

    days = calendar(panel).where(F.col("day_idx").between(day_idx - window + 1, day_idx))
    rows = panel.join(days, "key")
    edge = day_idx if align == "right" else max(0, day_idx - window + 1)
    codes = rows.where(F.col("day_idx") == edge).select("code").distinct()
    idx = F.explode(F.sequence(F.lit(max(0, day_idx - window + 1)), F.lit(day_idx))).alias("day_idx")
    grid = codes.select("code", idx).join(days, "day_idx")
    return grid.join(rows.drop("day_idx"), ["key", "code"], "left")


def last_by_code(df: DataFrame) -> DataFrame:
    """The newest row of each code."""
    w = Window.partitionBy("code").orderBy(F.col("key").desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
