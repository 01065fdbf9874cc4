"""Shifted targets: the value of the target some rows ahead, as a new column.

Rows whose future value is null, at the end or within, are dropped.  The order is global unless `by` names entity columns.  Both
forms keep many tasks: see operators.order for the global one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.errors import TargetColumnWarning
from tempora.frame import TemporalFrame
from tempora.functions import exprs as E
from tempora.operators.order import lead_in_order, leads_in_order


def shift_target(df: DataFrame, target: str, n: int, order: str, ties: tuple[str, ...] = (), by: tuple[str, ...] = (), ascending: bool = True, drop_target: bool = True) -> DataFrame:
    """df with {target}_shift_{n}; without the target if drop_target."""
    name = f"{target}_shift_{n}"
    if by:
        key = E.time_number(df, order)
        keys = [key.asc_nulls_first() if ascending else key.desc_nulls_first(), *[F.col(t) for t in ties]]
        out = df.withColumn(name, F.lead(target, n).over(Window.partitionBy(*by).orderBy(*keys)))
    else:
        out = lead_in_order(df, target, n, order, name, ties, ascending)
    out = out.where(F.col(name).isNotNull())
    return out.drop(target) if drop_target else out


def shift_steps(df: DataFrame, target: str, n: int, order: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """df with {target}_next array<double>: the n values that follow, for rows that have all of them."""
    names = {k: f"_tempora_s{k}" for k in range(1, n + 1)}
    if by:
        w = Window.partitionBy(*by).orderBy(E.time_number(df, order).asc_nulls_first(), *ties)
        df = df.withColumns({name: F.lead(target, k).over(w) for k, name in names.items()})
    else:
        df = leads_in_order(df, target, names, order, ties)
    out = df.withColumn(f"{target}_next", F.array(*[F.col(c).cast("double") for c in names.values()]))
    return out.where(F.forall(f"{target}_next", lambda x: x.isNotNull())).drop(*names.values())


class TargetShifter:
    """fit, transform and fit_transform over a TemporalFrame, a DataFrame (with an order column) or a NumPy matrix (last column the target)."""

    def __init__(self, target_col: str | None = None, n_lags: int = 1, drop_target: bool = True, order: str | None = None, by: tuple[str, ...] = ()):
        if n_lags <= 0:
            raise ValueError("`n_lags` must be greater than 0.")
        self.target_col, self.n_lags, self.drop_target, self.order, self.by = target_col, n_lags, drop_target, order, tuple(by)

    def fit(self, x) -> TargetShifter:
        if isinstance(x, TemporalFrame):
            if self.target_col not in (None, x.roles.target):
                warnings.warn(f"target '{self.target_col}' is replaced by the frame's '{x.roles.target}'", TargetColumnWarning, stacklevel=2)
            self.target_col = x.roles.target
        elif isinstance(x, DataFrame):
            if self.target_col is None:
                raise ValueError("Target column must be set before transform")
            if self.target_col not in x.columns:
                raise ValueError(f"Column {self.target_col} does not exist")
        else:
            self.target_col = f"feature_{x.shape[1] - 1}"
        return self

    def transform(self, x):
        if self.target_col is None:
            raise ValueError("Target column must be set before transform")
        if isinstance(x, TemporalFrame):
            r = x.roles
            out = self._apply(x.df, r.time, r.ties, self.by, r.ascending)
            return x.with_df(out, target=f"{self.target_col}_shift_{self.n_lags}")
        if isinstance(x, DataFrame):
            if self.order is None:
                raise ValueError("a plain DataFrame needs an order column")
            return self._apply(x, self.order, (), self.by, True)
        spark = SparkSession.active()
        names = [f"feature_{k}" for k in range(x.shape[1])]
        df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], ", ".join(["_row bigint", *[f"{c} double" for c in names]]))
        return self._apply(df, "_row", (), (), True).orderBy("_row").drop("_row").toPandas().to_numpy()  # as large as what came in

    def _apply(self, df: DataFrame, order: str, ties: tuple[str, ...], by: tuple[str, ...], ascending: bool) -> DataFrame:
        if df.isEmpty():
            raise ValueError("Cannot transform empty DataFrame")
        out = shift_target(df, self.target_col, self.n_lags, order, ties, by, ascending, self.drop_target)
        if out.isEmpty():
            raise ValueError("All rows were dropped during transformation")
        return out

    def fit_transform(self, x):
        return self.fit(x).transform(x)
