"""Quality report of a data set: one fused aggregate, then verdicts."""

from __future__ import annotations

import os
import warnings
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import exprs as E
from tempora.operators.checks import castable_counts
from tempora.staging import stage

CHECKS = ("sample_size", "feature_count", "feature_ratio", "feature_variability", "class_balance")
EXTENDED = ("categorical_cardinality", "binary_features")


@dataclass
class CheckResult:
    passed: bool
    message: str | None = None
    details: dict[str, Any] = field(default_factory=dict)
    severity: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def to_log_entry(self) -> dict[str, Any]:
        return {"validation_passed": self.passed, "validation_message": self.message, "validation_details": self.details, "log_level": self.severity or ("INFO" if self.passed else "WARNING")}


def failed_checks(results: dict[str, CheckResult]) -> dict[str, CheckResult]:
    return {k: r for k, r in results.items() if not r.passed}


def summary(results: dict[str, CheckResult]) -> dict[str, Any]:
    bad = len(failed_checks(results))
    return {"total_checks": len(results), "passed_checks": len(results) - bad, "failed_checks": bad, "check_details": {k: r.to_dict() for k, r in results.items()}}


def quality_counts(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """One row: n_rows, and per feature {f}_missing and {f}_unique (null counted as a value), in one pass."""
    out = [F.count("*").alias("n_rows")]
    for f in features:
        out += [E.n_missing(df, f).alias(f"{f}_missing"), E.n_unique(f).cast("bigint").alias(f"{f}_unique")]
    if target:
        out.append(F.count(target).alias("n_target"))
    return df.agg(*out)


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Rows of each class and their ratio to the smallest class."""
    n = stage(df.groupBy(column).agg(F.count("*").alias("n")), "classes")  # counted once; one row per class
    return n.withColumn("ratio", F.col("n") / F.lit(float(n.agg(F.min("n")).first()[0] or 1)))


class QualityReport:
    """fit checks types and missing values, transform runs the checks, report() gives them as a DataFrame."""

    def __init__(self, time_col: str, target_col: str, min_samples: int = 3000, max_samples: int = 50000, min_features: int = 4, max_features: int = 500, max_feature_ratio: float = 0.1, min_unique_values: int = 10, max_categorical_values: int = 20, class_imbalance_threshold: float = 1.5, checks: list[str] | None = None, enable_warnings: bool = True, extended: bool = False):
        known = {*CHECKS, *EXTENDED}
        if checks and set(checks) - known:
            raise ValueError(f"Invalid checks: {sorted(set(checks) - known)}")
        self.time_col, self.target_col = time_col, target_col
        self.min_samples, self.max_samples, self.min_features, self.max_features = min_samples, max_samples, min_features, max_features
        self.max_feature_ratio, self.min_unique_values, self.max_categorical_values = max_feature_ratio, min_unique_values, max_categorical_values
        self.class_imbalance_threshold, self.enable_warnings, self.extended = class_imbalance_threshold, enable_warnings, extended
        self.checks = list(checks) if checks else [*CHECKS, *(EXTENDED if extended else ())]

    def features(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in {self.time_col, self.target_col}]

    def fit(self, df: DataFrame) -> QualityReport:
        if not isinstance(df, DataFrame):
            raise TypeError("Input must be convertible to a Spark DataFrame")
        for c in (self.time_col, self.target_col):
            if c not in df.columns:
                raise ValueError(f"Column '{c}' does not exist")
        texts = [c for c in df.columns if c != self.time_col and not E.is_number(E.dtype(df, c)) and df.schema[c].dataType.typeName() != "boolean"]
        if texts:
            bad = castable_counts(df, texts).first().asDict()
            for c in texts:
                if bad[f"{c}_not_number"]:
                    raise ValueError(f"Column {c} must be numeric")
        lost = df.agg(*[E.n_missing(df, c).alias(c) for c in df.columns]).first().asDict()
        if any(lost.values()):
            raise ValueError(f"Missing values detected in columns: {', '.join(c for c, n in lost.items() if n)}")
        return self

    def verdicts(self, counts: dict[str, int], features: list[str], target: str | None) -> dict[str, CheckResult]:
        """The verdicts from one row of quality_counts."""
        n, f, out = counts["n_rows"] or 0, len(features), {}
        for check in self.checks:
            if check == "sample_size":
                few, many = n < self.min_samples, n > self.max_samples
                out[check] = CheckResult(not (few or many), f"{'Dataset has ' + str(n) + ' samples, ' + ('minimum is ' + str(self.min_samples) if few else 'maximum is ' + str(self.max_samples))}" if few or many else None, {"num_samples": n}, "WARNING" if few or many else "INFO")
            elif check == "feature_count":
                bad = f < self.min_features or f > self.max_features
                out[check] = CheckResult(not bad, f"{f} features are outside {self.min_features} to {self.max_features}" if bad else None, {"num_features": f}, "WARNING" if bad else "INFO")
            elif check == "feature_ratio":
                ratio = f / n if n and f else 0.0
                bad = not n or not f or ratio > self.max_feature_ratio
                out[check] = CheckResult(not bad, f"feature to sample ratio {ratio:.3f} is above {self.max_feature_ratio}" if bad else None, {"ratio": round(ratio, 3)}, "WARNING" if bad else "INFO")
            elif check == "feature_variability":
                low = [c for c in features if counts[f"{c}_unique"] < self.min_unique_values or counts[f"{c}_missing"]]
                out[check] = CheckResult(not low, f"low variability: {', '.join(low)}" if low else None, {"numeric_feature": True} | {c: counts[f"{c}_unique"] for c in features}, "WARNING" if low else "INFO")
            elif check == "class_balance":
                if not target:
                    out[check] = CheckResult(True, "No target column specified", {}, "INFO")
                else:
                    out[check] = CheckResult(True, None, {"total_samples": counts.get("n_target", n)}, "INFO")
            elif check == "categorical_cardinality":
                low = [c for c in features if counts[f"{c}_unique"] <= self.max_categorical_values]
                out[check] = CheckResult(True, None, {c: counts[f"{c}_unique"] for c in low}, "INFO")
            elif check == "binary_features":
                out[check] = CheckResult(True, None, {c: 2 for c in features if counts[f"{c}_unique"] == 2}, "INFO")
        return out

    def transform(self, df: DataFrame, target_col: str | None = None) -> dict[str, CheckResult]:
        features = self.features(df)
        out = self.verdicts(quality_counts(df, features, target_col).first().asDict(), features, target_col)
        if self.extended and target_col and "class_balance" in out:
            worst = class_balance(df, target_col).agg(F.max("ratio")).first()[0] or 1.0
            out["class_balance"] = CheckResult(worst <= self.class_imbalance_threshold, None, {"ratio": worst}, "WARNING" if worst > self.class_imbalance_threshold else "INFO")
        bad = failed_checks(out)
        if bad and self.enable_warnings:
            kind = RuntimeWarning if any(r.severity == "ERROR" for r in bad.values()) else UserWarning
            warnings.warn(f"Failed checks: {', '.join(bad)}", kind, stacklevel=2)
        return out

    def fit_transform(self, df: DataFrame, target_col: str | None = None) -> dict[str, CheckResult]:
        return self.fit(df).transform(df, target_col)

    def report(self, df: DataFrame, target_col: str | None = None) -> DataFrame:
        """check, passed, value: the verdicts as rows, lazily, from the one aggregate."""
        features = self.features(df)
        n, f = F.col("n_rows"), len(features)
        low = F.lit(0)
        for c in features:
            low = low + ((F.col(f"{c}_unique") < self.min_unique_values) | (F.col(f"{c}_missing") > 0)).cast("int")
        ratio = F.when((n > 0) & F.lit(f > 0), F.lit(float(f)) / n).otherwise(0.0)
        rows = {
            "sample_size": ((n >= self.min_samples) & (n <= self.max_samples), n.cast("double")),
            "feature_count": (F.lit(self.min_features <= f <= self.max_features), F.lit(float(f))),
            "feature_ratio": ((n > 0) & F.lit(f > 0) & (ratio <= self.max_feature_ratio), F.round(ratio, 6)),
            "feature_variability": (low == 0, low.cast("double")),
            "class_balance": (F.lit(True), F.col("n_target").cast("double") if target_col else F.lit(0.0)),
        }
        parts = [F.struct(F.lit(k).alias("check"), rows[k][0].alias("passed"), rows[k][1].alias("value")) for k in self.checks if k in rows]
        return quality_counts(df, features, target_col).select(F.explode(F.array(*parts)).alias("r")).select("r.*")

    def print_report(self, results: dict[str, CheckResult]) -> None:
        for k, r in results.items():
            print(f"{'✓' if r.passed else '✗'} {k:<24} {r.message or ''} {r.details}")


def describe_column(df: DataFrame, name: str, categorical: bool = False) -> DataFrame:
    """n, n_missing, n_unique, and for numbers mean, low and high."""
    out = [F.count("*").alias("n"), E.n_missing(df, name).alias("n_missing"), E.n_unique(name).cast("bigint").alias("n_unique")]
    if not categorical:
        c = F.col(name).try_cast("double") if not E.is_number(E.dtype(df, name)) else F.col(name).cast("double")
        out += [F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high")]
    return df.agg(*out)


def features_to_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Each column as a double; texts lose their first comma, and what is no number becomes null."""
    return df.withColumns({n: F.col(n).cast("double") if E.is_number(E.dtype(df, n)) else E.number_from_text(F.col(n).cast("string")) for n in names})


def print_divider(char: str = "=", length: int = 70) -> None:
    print(char * length)


def keys_from_environment(names: list[str]) -> dict[str, str | None]:
    """The values of environment variables, such as keys of model services; None and a warning for those that are not set."""
    out = {n: os.environ.get(n) for n in names}
    for n, v in out.items():
        if v is None:
            warnings.warn(f"environment variable {n} is not set", UserWarning, stacklevel=2)
    return out
