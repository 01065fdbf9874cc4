"""Feature attributions summarised per window, and models fitted per window.

An explainer adds one attribution column per feature.  The linear one is columns only: coefficient * (value - mean of the window's
training rows).  Any other model explains Arrow batches through mapInPandas, and models are fitted per window by applyInPandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def linear_attributions(windows: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """windows(window_id, features...) with attr_{feature}."""
    w = Window.partitionBy("window_id")
    return windows.withColumns({f"attr_{f}": F.lit(float(b)) * (F.col(f) - F.avg(f).over(w)) for f, b in coefficients.items()})


def explained(windows: DataFrame, features: list[str], explain: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """windows with attr_{feature} from a function over batches of feature columns."""
    schema = T.StructType([*windows.schema.fields, *[T.StructField(f"attr_{f}", T.DoubleType()) for f in features]])

    def run(batches):
        for b in batches:
            got = explain(b[features])
            yield b.assign(**{f"attr_{f}": got[f].astype(float).to_numpy() for f in features})

    return windows.mapInPandas(run, schema)


def mean_absolute_attributions(attributed: DataFrame, features: list[str], split: str | None = "train") -> DataFrame:
    """window_id and, per feature, the mean of the absolute attributions of the window's rows (of its training part)."""
    rows = attributed.where(F.col("split") == split) if split else attributed
    return rows.groupBy("window_id").agg(*[F.avg(F.abs(F.col(f"attr_{f}"))).alias(f) for f in features])


def by_feature(scores: DataFrame, features: list[str]) -> DataFrame:
    """feature, window_id, score, and the feature's rank in its window."""
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("score")) for f in features])
    rows = scores.select("window_id", F.explode(parts).alias("r")).select("window_id", "r.*")
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("window_id").orderBy(F.col("score").desc())))


def least_squares_per_window(windows: DataFrame, features: list[str], target: str) -> DataFrame:
    """window_id, n_train, n_test, rmse, coefficients map, from the windows' means and covariances: one pre-aggregated pass over the rows,
    and one small linear system per window.  Rows with a null or NaN are left out.  A feature that is the same in all training rows has no
    slope: its coefficient is NaN, and it takes no part in the predictions."""
    names = [*features, target]
    good = F.lit(True)
    for c in names:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = windows.where(good)
    out = []
    for part in ("train", "test"):
        v = {c: F.when(F.col("split") == part, F.col(c).cast("double")) for c in names}
        out.append(F.count(v[target]).alias(f"n_{part}"))
        out.append(F.array(*[F.avg(v[c]) for c in names]).alias(f"mean_{part}"))
        out.append(F.array(*[F.covar_pop(v[a], v[b]) for a in names for b in names]).alias(f"cov_{part}"))
    moments = rows.groupBy("window_id").agg(*out)
    d = len(features)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for r in batch.to_pylist():
                if not r["n_train"]:
                    got.append((None, {}))
                    continue
                c = np.array(r["cov_train"], float).reshape(d + 1, d + 1)
                b = np.linalg.lstsq(c[:d, :d], c[:d, d], rcond=None)[0]
                error = None
                if r["n_test"]:
                    full = np.append(b, -1.0)
                    bias = (np.array(r["mean_test"], float) - np.array(r["mean_train"], float)) @ full
                    error = float(np.sqrt(max(0.0, full @ np.array(r["cov_test"], float).reshape(d + 1, d + 1) @ full + bias * bias)))
                b[np.diag(c)[:d] == 0] = np.nan
                got.append((error, dict(zip(features, b.tolist(), strict=True))))
            # Arrow, since pandas would make the NaNs null
            maps = pa.array([list(g[1].items()) for g in got], pa.map_(pa.string(), pa.float64()))
            names = ["window_id", "n_train", "n_test", "rmse", "coefficients"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names[:3]], pa.array([g[0] for g in got], pa.float64()), maps], names=names)

    return moments.mapInArrow(solve, "window_id bigint, n_train bigint, n_test bigint, rmse double, coefficients map<string,double>")


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 32) -> tuple[Callable, dict]:
    """Gradient boosting of one-cut trees on squared error; (predict, rounds in which each column was cut)."""
    cuts = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
    place = [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)]
    base, steps, used = float(y.mean()), [], {}
    rest = y - base
    for _ in range(rounds):
        best = (0.0, None)
        for j, p in enumerate(place):
            n, s = np.cumsum(np.bincount(p, minlength=len(cuts[j]) + 1))[:-1], np.cumsum(np.bincount(p, rest, len(cuts[j]) + 1))[:-1]
            m, t = len(rest) - n, rest.sum() - s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.nan_to_num(s * s / n + t * t / m - rest.sum() ** 2 / len(rest), nan=0.0, posinf=0.0)
            if len(gain) and gain.max() > best[0] + 1e-12:
                k = int(gain.argmax())
                best = (float(gain[k]), (j, cuts[j][k], rate * s[k] / n[k], rate * t[k] / m[k]))
        if best[1] is None:
            break
        j, cut, low, high = best[1]
        steps.append(best[1])
        used[j] = used.get(j, 0) + 1
        rest = rest - np.where(x[:, j] < cut, low, high)
    return (lambda z: base + sum((np.where(z[:, j] < cut, low, high) for j, cut, low, high in steps), np.zeros(len(z)))), used


def train_per_window(windows: DataFrame, features: list[str], target: str, fit: Callable | None = None) -> DataFrame:
    """window_id, n_train, n_test, rmse, coefficients map: a model fitted to each window's training rows and tried on its test rows.

    By default least squares from sums.  With fit(x, y) -> (predict(x), coefficients) a window's rows meet in one worker, so windows
    have to fit into one; their size is the caller's parameter.
    """
    if fit is None:
        return least_squares_per_window(windows, features, target)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        train, test = rows[rows["split"] == "train"], rows[rows["split"] == "test"]
        if train.empty:
            return pd.DataFrame({"window_id": [key[0]], "n_train": [0], "n_test": [len(test)], "rmse": [None], "coefficients": [{}]})
        predict, coefficients = fit(train[features].to_numpy(float), train[target].to_numpy(float))
        error = predict(test[features].to_numpy(float)) - test[target].to_numpy(float) if len(test) else None
        return pd.DataFrame({"window_id": [key[0]], "n_train": [len(train)], "n_test": [len(test)], "rmse": [float(np.sqrt(np.mean(error**2))) if error is not None else None], "coefficients": [{str(k): float(v) for k, v in coefficients.items()}]})

    cols = ["window_id", "split", target, *features]
    return windows.select(*cols).groupBy("window_id").applyInPandas(run, "window_id bigint, n_train bigint, n_test bigint, rmse double, coefficients map<string,double>")


class WindowTrainer:
    """A model per window: by default boosted trees, else any fit(x, y) -> (predict, coefficients)."""

    def __init__(self, partitioner, features: list[str], target: str, fit: Callable | None = None):
        self.partitioner, self.features, self.target, self.fit = partitioner, list(features), target, fit or boosted

    def train_and_evaluate(self, df: DataFrame) -> DataFrame:
        """window_id, n_train, n_test, rmse, coefficients of every window."""
        return train_per_window(self.partitioner.fit_transform(df), self.features, self.target, self.fit)

    def predictions(self, df: DataFrame) -> DataFrame:
        """The rows of all windows with a column `prediction`, from the model of the window's training rows."""
        rows, features, target, fit = self.partitioner.fit_transform(df), self.features, self.target, self.fit
        schema = T.StructType([*rows.schema.fields, T.StructField("prediction", T.DoubleType())])

        def run(own: pd.DataFrame) -> pd.DataFrame:
            train = own[own["split"] == "train"]
            predict = fit(train[features].to_numpy(float), train[target].to_numpy(float))[0] if len(train) else lambda z: np.full(len(z), np.nan)
            return own.assign(prediction=predict(own[features].to_numpy(float)))

        return rows.groupBy("window_id").applyInPandas(run, schema)
