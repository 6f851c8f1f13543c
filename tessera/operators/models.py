"""Rolling models: ridge in closed form, gradient boosted trees, a small network, and their retraining.

A rolling run trains on the days before each training date (every ``retrain_every``-th day with
enough history), leaving out the last ``fwd + 1`` days of the window whose labels reach past it,
and predicts the days up to the next training date. Ridge takes one pass over the rows for all
training dates: a task sums the Gram matrices of its days, days meet in the windows they belong to, and
a window is solved where its sum is; nothing reaches the driver. Other models fit date by date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.kernels import Kernels
from tessera.operators.signals import correlation

RIDGE_ALPHA = 42.0
LEAST_DAYS, LEAST_ROWS = 10, 50


def usable(features: list[str], label: str = "label") -> Column:
    """Rows to train on: a label, and at most half of the features missing."""
    missing = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    return F.col(label).isNotNull() & (missing <= len(features) / 2)


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing and infinite features as 0."""
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)), F.lit(0.0)) for c in features})


@dataclass
class Linear:
    features: list[str]
    weights: np.ndarray
    intercept: float

    def column(self) -> Column:
        return sum((F.col(c) * float(w) for c, w in zip(self.features, self.weights)), F.lit(float(self.intercept)))

    def importance(self) -> dict[str, float]:
        size = np.abs(self.weights)
        return dict(zip(self.features, (size / size.sum() if size.sum() else size).tolist()))


def gram(df: DataFrame, features: list[str], label: str = "label") -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, sums of x, sum of y and rows, by one aggregate with partial sums in each task."""
    p = len(features)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p + 2, p + 2))
        for pdf in batches:
            x = np.column_stack([pdf[[*features, label]].to_numpy(float), np.ones(len(pdf))])
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    sums = df.select(*features, label).mapInPandas(part, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    m = np.zeros((p + 2) ** 2)
    for r in sums.collect():  # (features + 2)^2 numbers
        m[r["cell"]] = r["value"]
    m = m.reshape(p + 2, p + 2)
    return m[:p, :p], m[:p, p], m[:p, p + 1], float(m[p, p + 1]), int(round(m[p + 1, p + 1]))


def ridge(df: DataFrame, features: list[str], label: str = "label", alpha: float = RIDGE_ALPHA) -> Linear | None:
    """Least squares with an L2 penalty and a free intercept; None below ``LEAST_ROWS`` rows."""
    xx, xy, sx, sy, n = gram(df, features, label)
    if n < LEAST_ROWS:
        return None
    mx, my = sx / n, sy / n
    w = np.linalg.solve(xx - n * np.outer(mx, mx) + alpha * np.eye(len(features)), xy - n * mx * my)
    return Linear(features, w, float(my - mx @ w))


def boosted_trees(df: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 4, rate: float = 0.1):
    """Gradient boosted trees by Spark ML; gives a function of frames that adds ``_pred``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gather = VectorAssembler(inputCols=features, outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="_pred", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=42).fit(gather.transform(df.select(*features, label)))
    return lambda rows: model.transform(gather.transform(rows)).drop("_x")


def mse_loss(pred: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and curvature of the mean squared error."""
    return float(np.mean((pred - y) ** 2)), 2 * (pred - y) / len(y), np.full(len(y), 2 / len(y))


def ic_loss(pred: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the Pearson correlation, its gradient, and a constant curvature."""
    p, t = pred - pred.mean(), y - y.mean()
    sp, st = np.sqrt(p @ p), np.sqrt(t @ t)
    if sp == 0 or st == 0:
        return 0.0, np.zeros(len(y)), np.full(len(y), 1 / len(y))
    ic = float(p @ t / (sp * st))
    return -ic, -(t / (sp * st) - ic * p / sp**2), np.full(len(y), 1 / len(y))


LOSSES: dict[str, Callable] = {"mse": mse_loss, "ic": ic_loss}


class Network:
    """A small network (ReLU layers, optional residual blocks) fitted by AdamW with averaged weights."""

    def __init__(self, sizes: tuple[int, ...] = (32, 16), loss: str = "mse", residual: bool = False, epochs: int = 20, batch: int = 256, rate: float = 1e-3, decay: float = 1e-2, average: float = 0.99, noise: float = 0.01, clip: float = 5.0, patience: int = 5, seed: int = 0):
        self.sizes, self.loss, self.residual, self.epochs, self.batch = sizes, LOSSES[loss], residual, epochs, batch
        self.rate, self.decay, self.average, self.noise, self.clip, self.patience = rate, decay, average, noise, clip, patience
        self.rng = np.random.default_rng(seed)
        self.layers: list[list[np.ndarray]] = []

    def _forward(self, x: np.ndarray, layers: list) -> tuple[np.ndarray, list]:
        seen = []
        for k, (w, b) in enumerate(layers):
            z = x @ w + b
            seen.append((x, z))
            if k == len(layers) - 1:
                x = z
            else:
                x = np.maximum(z, 0) + (x if self.residual and x.shape[1] == z.shape[1] else 0)
        return x[:, 0], seen

    def _gradients(self, seen: list, g: np.ndarray, layers: list) -> list:
        out, g = [], g[:, None]
        for k in range(len(layers) - 1, -1, -1):
            x, z = seen[k]
            through = g if k == len(layers) - 1 else g * (z > 0)
            out.append([x.T @ through, through.sum(0)])
            back = through @ layers[k][0].T
            g = back + (g if self.residual and k < len(layers) - 1 and x.shape[1] == z.shape[1] else 0)
        return out[::-1]

    def fit(self, x: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None) -> Network:
        widths = [x.shape[1], *self.sizes, 1]
        layers = [[self.rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(widths, widths[1:])]
        mean = [[p.copy() for p in layer] for layer in layers]
        m = [[np.zeros_like(p) for p in layer] for layer in layers]
        v = [[np.zeros_like(p) for p in layer] for layer in layers]
        step, best, waited = 0, np.inf, 0
        for _ in range(self.epochs):
            order = self.rng.permutation(len(x))
            for i in range(0, len(x), self.batch):
                at = order[i : i + self.batch]
                xb = x[at] + self.rng.normal(0, self.noise, x[at].shape)
                pred, seen = self._forward(xb, layers)
                grads = self._gradients(seen, self.loss(pred, y[at])[1], layers)
                norm = np.sqrt(sum((p**2).sum() for layer in grads for p in layer))
                scale = min(1.0, self.clip / norm) if norm else 1.0
                step += 1
                for layer, ml, vl, gl, al in zip(layers, m, v, grads, mean):
                    for k in (0, 1):
                        g = gl[k] * scale
                        ml[k] = 0.9 * ml[k] + 0.1 * g
                        vl[k] = 0.999 * vl[k] + 0.001 * g * g
                        layer[k] = layer[k] - self.rate * (ml[k] / (1 - 0.9**step) / (np.sqrt(vl[k] / (1 - 0.999**step)) + 1e-8) + self.decay * layer[k] * (k == 0))
                        al[k] = self.average * al[k] + (1 - self.average) * layer[k]
            if held is not None:
                now = self.loss(self._forward(held[0], mean)[0], held[1])[0]
                best, waited = (now, 0) if now < best else (best, waited + 1)
                if waited >= self.patience:
                    break
        self.layers = mean
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x, self.layers)[0]

    def importance(self) -> np.ndarray:
        size = np.abs(self.layers[0][0]).mean(1)
        return size / size.sum()


def network(df: DataFrame, features: list[str], label: str = "label", max_rows: int = 200_000, **settings):
    """Fit a network on at most ``max_rows`` rows (those with the smallest hash of day and code)."""
    rows = df.orderBy(F.xxhash64("day_idx", "code")).limit(max_rows).select(*features, label).toPandas()
    net = Network(**settings).fit(rows[features].to_numpy(float), rows[label].to_numpy(float))

    def predict(frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(_pred=net.predict(pdf[features].to_numpy(float)))

        return frame.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) + ", _pred double")

    return predict


def _ridge_model(df: DataFrame, features: list[str], label: str = "label", **kw):
    model = ridge(df, features, label, **kw)
    return None if model is None else (lambda rows: rows.withColumn("_pred", model.column()))


MODELS: dict[str, Callable] = {"ridge": _ridge_model, "gbt": boosted_trees, "mlp": network}


def train_days(n_days: int, model_window: int, fwd: int, retrain_every: int) -> list[tuple[int, int, int, int]]:
    """(first, last day to train on; first, last day to predict) of each training date."""
    out = []
    first = model_window + fwd
    for t in range(first, n_days, retrain_every):
        out.append((t - model_window - fwd, t - fwd - 1, t, min(n_days - 1, t + retrain_every - 1)))
    return out


WEIGHTS = "date int, first int, last int, weights array<double>, intercept double"


def rolling_ridge(ready: DataFrame, features: list[str], dates: list[tuple[int, int, int, int]], label: str = "label", alpha: float = RIDGE_ALPHA) -> DataFrame:
    """``WEIGHTS`` of every training date with enough rows, from one pass over ``ready``.

    Rows are dealt out by day, so that a day's matrix is summed in one task; a matrix is sent once for
    each window that its day lies in.
    """
    p = len(features)
    spans = np.array(dates, int).reshape(-1, 4)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            day = pdf["day_idx"].to_numpy()
            x = np.column_stack([pdf[[*features, label]].to_numpy(float), np.ones(len(pdf))])
            for d in np.unique(day):
                own = x[day == d]
                for i in np.flatnonzero((spans[:, 0] <= d) & (d <= spans[:, 1])):
                    held[int(i)] = held.get(int(i), 0) + own.T @ own
        yield pd.DataFrame({"date": list(held), "gram": [m.astype("<f8").tobytes() for m in held.values()]})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        date, total = None, np.zeros((p + 2, p + 2))

        def row() -> pd.DataFrame:
            n = int(round(total[p + 1, p + 1]))
            if date is None or n < LEAST_ROWS:
                return pd.DataFrame([], columns=["date", "first", "last", "weights", "intercept"])
            mx, my = total[:p, p + 1] / n, total[p, p + 1] / n
            w = np.linalg.solve(total[:p, :p] - n * np.outer(mx, mx) + alpha * np.eye(p), total[:p, p] - n * mx * my)
            return pd.DataFrame([(date, spans[date, 2], spans[date, 3], w.tolist(), float(my - mx @ w))], columns=["date", "first", "last", "weights", "intercept"])

        for pdf in batches:  # sorted by date: one sum is held at a time
            for d, g in zip(pdf["date"], pdf["gram"]):
                if d != date:
                    yield row()
                    date, total = d, np.zeros((p + 2, p + 2))
                total += np.frombuffer(g, "<f8").reshape(p + 2, p + 2)
        yield row()

    grams = ready.select("day_idx", *features, label).repartition("day_idx").mapInPandas(part, "date int, gram binary")
    return grams.repartition("date").sortWithinPartitions("date", "gram").mapInPandas(solve, WEIGHTS)


def rolling_predictions(rows: DataFrame, features: list[str], n_days: int, model: str = "ridge", model_window: int = 60, fwd: int = 5, retrain_every: int = 20, **settings) -> DataFrame:
    """``(key, code, day_idx, _pred)`` over all training dates; a date without enough data gives 0."""
    spark = rows.sparkSession
    ready = filled(rows.where(usable(features)), features)
    ask = filled(rows, features)
    dates = [d for d in train_days(n_days, model_window, fwd, retrain_every)]
    if model == "ridge" and dates:
        asked = ask.where(F.col("day_idx").between(dates[0][2], dates[-1][3]))
        date = F.floor((F.col("day_idx") - dates[0][2]) / retrain_every).cast("int")
        if model_window < LEAST_DAYS:
            return asked.select("key", "code", "day_idx", F.lit(0.0).alias("_pred"))
        weights = F.broadcast(rolling_ridge(ready, features, dates, **settings).select("date", "weights", "intercept"))  # a row for each training date
        dot = F.aggregate(F.zip_with(F.array(*features), "weights", lambda x, w: x * w), F.col("intercept"), lambda a, x: a + x)
        return asked.withColumn("date", date).join(weights, "date", "left").select("key", "code", "day_idx", F.coalesce(dot, F.lit(0.0)).alias("_pred"))
    out = None
    for a, b, c, d in dates:
        known = ready.where(F.col("day_idx").between(a, b))
        span = ask.where(F.col("day_idx").between(c, d))
        fitted = MODELS[model](known, features, **settings) if b - a + 1 >= LEAST_DAYS else None
        block = (span.withColumn("_pred", F.lit(0.0)) if fitted is None else fitted(span)).select("key", "code", "day_idx", "_pred")
        out = block if out is None else out.unionByName(block)
    return out if out is not None else spark.createDataFrame([], "key date, code string, day_idx bigint, _pred double")


def standardised(predictions: DataFrame, name: str = "pred_signal") -> DataFrame:
    """Predictions as z-scores of their day, population deviation."""
    k = Kernels()
    return k.apply(predictions.withColumn("present", F.lit(True)), {name: k.cs_z_pop("_pred")}, ("key", "code", "day_idx"))


def time_series_folds(n_days: int, folds: int = 3) -> list[tuple[int, int, int]]:
    """(days to train on, first and last day to validate on) of folds that grow over time."""
    size = n_days // (folds + 1)
    return [(size * k + n_days - size * (folds + 1), size * k + n_days - size * (folds + 1), size * (k + 1) + n_days - size * (folds + 1) - 1) for k in range(1, folds + 1)] if size else []


def cross_validation(rows: DataFrame, features: list[str], n_days: int, model: str = "ridge", folds: int = 3, least: int = 10, **settings) -> DataFrame:
    """``(fold, n, rank_ic)``: mean daily rank correlation on the days after those trained on.

    Folds grow over time and are cut at days, so no day is trained on and validated on.
    """
    ready = filled(rows.where(usable(features)), features)
    out = None
    for k, (n, a, b) in enumerate(time_series_folds(n_days, folds)):
        fitted = MODELS[model](ready.where(F.col("day_idx") < n), features, **settings)
        if fitted is None:
            continue
        held = fitted(ready.where(F.col("day_idx").between(a, b))).withColumn("present", F.lit(True))
        kernels = Kernels()
        ranked = kernels.apply(held, {"x": kernels.cs_rank("_pred"), "y": kernels.cs_rank("label")}, ("key",))
        days = ranked.groupBy("key").agg(F.count("*").alias("n"), F.coalesce(correlation("x", "y"), F.lit(0.0)).alias("ic"))
        fold = days.agg(F.lit(k).alias("fold"), F.sum("n").alias("n"), F.avg("ic").alias("rank_ic")).where(f"n >= {least}")
        out = fold if out is None else out.unionByName(fold)
    return out if out is not None else rows.sparkSession.createDataFrame([], "fold int, n bigint, rank_ic double")


def scaled_importance(importance: dict[str, float]) -> dict[str, float]:
    """Importances between 0 and 1, largest first."""
    low, high = min(importance.values()), max(importance.values())
    return {c: (v - low) / (high - low) if high > low else 0.0 for c, v in sorted(importance.items(), key=lambda x: -x[1])}
