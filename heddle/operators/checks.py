"""Validations of metrics: thresholds, freshness, drift by partition step, forecasts; and what collects the metrics for them.

Severity is 2 for an error, 1 for a warning, 0 for a pass. All segments are judged at once, each by its own rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import severity

_BREAKS = {"min": lambda v, t: v < t, "max": lambda v, t: v > t, "eq": lambda v, t: v != t, "neq": lambda v, t: v == t, "gt": lambda v, t: ~(v > t), "lt": lambda v, t: ~(v < t), "gte": lambda v, t: ~(v >= t), "lte": lambda v, t: ~(v <= t)}
#: What may be validated by what.
MATRIX = {"aggregation": ("threshold", "drift", "trend"), "metrics": ("threshold", "drift", "trend"), "custom_query": ("threshold", "drift", "trend"), "profiling": ("threshold", "drift"), "sample": ("shape", "pattern"), "recency": ("slo",)}


def check_pair(collector: str, validator: str) -> None:
    """ValueError unless the validator can judge what the collector gives."""
    if validator not in MATRIX.get(collector, ()):
        raise ValueError(f"{validator} does not apply to {collector}; it takes {MATRIX.get(collector, ())}")


def step_seconds(step: str) -> int:
    """Seconds of an ISO 8601 duration of weeks, days, hours, minutes and seconds: P7D, PT1H. Months and years are not of one length."""
    m = re.fullmatch(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", step.strip().upper())
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {step!r}")
    return sum(int(n or 0) * s for n, s in zip(m.groups(), (604800, 86400, 3600, 60, 1)))


def first_broken(value: Column, bounds: dict[str, float] | None) -> Column:
    """op=bound of the first bound that the value breaks, else NULL."""
    out = F.lit(None).cast("string")
    for op, bound in reversed(list((bounds or {}).items())):
        out = F.when(_BREAKS[op](value, F.lit(bound)), f"{op}={bound:g}").otherwise(out)
    return out


def threshold(metrics: DataFrame, rules: Sequence[dict], empty: int = 1) -> DataFrame:
    """(validation_name, metric_name, dimension_value, actual_value, severity, violated) of each rule and segment of its metric.

    A rule is {name, metric, warning, error}. A metric that was not collected is an error, a NULL value has the severity `empty`.
    """
    spark = metrics.sparkSession
    v = F.col("metric_value")
    each = [F.when(F.col("metric_name") == r["metric"], F.struct(F.lit(f"{r['name']}.{r['metric']}").alias("validation_name"), severity(v, r.get("error"), r.get("warning"), empty).alias("severity"), F.coalesce(first_broken(v, r.get("error")), first_broken(v, r.get("warning"))).alias("violated"))) for r in rules]
    rows = metrics.select("metric_name", "dimension_value", v.alias("actual_value"), F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
    named = spark.createDataFrame([(f"{r['name']}.{r['metric']}", r["metric"]) for r in rules], "validation_name string, metric_name string")
    gone = named.join(metrics.select("metric_name").distinct(), "metric_name", "left_anti")
    missing = gone.select("metric_name", F.lit(None).cast("string").alias("dimension_value"), F.lit(None).cast("double").alias("actual_value"), "validation_name", F.lit(2).alias("severity"), F.lit("missing").alias("violated"))
    return rows.unionByName(missing)


def recency(df: DataFrame, column: str) -> DataFrame:
    """(recency_ts): the newest value; NULL where there is none."""
    return df.agg(F.max(F.col(column).cast("timestamp")).alias("recency_ts"))


def file_recency(df: DataFrame) -> DataFrame:
    """(recency_ts) by the change of the files that a frame reads."""
    return df.select(F.col("_metadata.file_modification_time").alias("t")).agg(F.max("t").alias("recency_ts"))


def slo(newest: DataFrame, now: Column, warning: str | None = None, error: str | None = None) -> DataFrame:
    """(recency_ts, age_seconds, severity): late by more than a duration, strictly. No recency is an error."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds("recency_ts")
    bounds = lambda d: {"max": step_seconds(d)} if d else None
    return newest.withColumn("age_seconds", age).withColumn("severity", severity(F.col("age_seconds"), bounds(error), bounds(warning), 2))


def query_metrics(df: DataFrame, dims: Sequence[str] = (), partition_ts: str | None = None) -> DataFrame:
    """(metric_name, dims..., partition_ts, metric_value) of the numeric columns of a query's rows; a row's own partition goes before the constant."""
    own = "partition_ts" in df.columns
    names = [c for c, kind in df.dtypes if c not in dims and c != "partition_ts" and kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(f"`{n}`").cast("double").alias("metric_value")) for n in names])
    at = F.coalesce(F.col("partition_ts").cast("timestamp") if own else F.lit(None).cast("timestamp"), F.lit(partition_ts).cast("timestamp"))
    return df.select(*dims, at.alias("partition_ts"), F.inline(pairs))


def slices(df: DataFrame, at: str, anchor: str, step: str, past: int = 3, rows: int = 10_000, seed: int = 42, key: Sequence[str] = ()) -> DataFrame:
    """Rows of the slice at `anchor` and of those `past` steps before it, with _period 0, 1, ...; of each slice at most `rows`, by hash.

    A slice is a day where the step is whole days, else one step's length. `rows` is the size of the sample, which is the operator's purpose.
    """
    if anchor is None:
        raise ValueError("the dataset has no partition to anchor slices at")
    s = step_seconds(step)
    length = 86400 if s % 86400 == 0 else s
    age = F.unix_seconds(F.lit(anchor).cast("timestamp")) - F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / length) * length
    tagged = df.withColumn("_period", F.when(F.pmod(age, F.lit(s)) == 0, (age / s).cast("int")))
    order = F.xxhash64(*(key or df.columns), F.lit(seed))
    out = None
    for k in range(past + 1):
        one = tagged.where(F.col("_period") == k).orderBy(order).limit(rows)
        out = one if out is None else out.unionByName(one)
    return out


def hash_split(df: DataFrame, weights: Sequence[float], key: Sequence[str], seed: int = 42) -> list[DataFrame]:
    """Parts of about the given weights; a row's part follows from its key and the seed alone."""
    place = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    total, low, out = sum(weights), 0.0, []
    for i, w in enumerate(weights):
        high = low + w / total if i < len(weights) - 1 else 1.0
        out.append(df.where((place >= low) & (place < high)))
        low = high
    return out


def drift(series: DataFrame, at: str, value: str, step: str, by: Sequence[str] = (), past: int = 3, short: str = "ignore", none: str = "ignore", warning: dict | None = None, error: dict | None = None, collected: str | None = None) -> DataFrame:
    """Each point against the values at exactly one to `past` steps before it.

    A time has one value for the points after it: of several the one `collected` last, or without that column the greatest.

    Gives past_n, past_mean, deviation_abs and _pct, z_score, rate_of_change_abs and _pct (against the nearest past value) and severity.
    Percentages are of the absolute base; a base or deviation of zero gives 0. With fewer values than `past`, `short` is ignore (use what
    is there), substitute (their mean takes the missing places) or error. Without any, severity is that of `none`: ignore, warn or error.
    A NULL value is a warning. Bounds are {measure: {"min": x, "max": y}}, signed; an error goes before a warning.
    """
    s, codes = step_seconds(step), {"ignore": 0, "warn": 1, "error": 2}
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    rows = series.withColumn("_t", seconds)
    known = rows.where(F.col(value).isNotNull()).select(*by, "_t", F.col(value).cast("double").alias("_v"), (F.col(collected) if collected else F.col(value)).alias("_o"))
    known = known.groupBy(*by, "_t").agg(F.max_by("_v", F.struct("_o", "_v")).alias("_v"))
    seen = known.select(*by, "_v", "_t", F.explode(F.sequence(F.lit(1), F.lit(past))).alias("_k")).withColumn("_t", F.col("_t") + F.col("_k") * s)
    seen = seen.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_t").alias("_at")).agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_seen"))  # at most `past`
    rows = rows.join(seen, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_by_{c}")), by, F.col("_t") == F.col("_at")), "left").drop("_at", *[f"_by_{c}" for c in by])
    rows = rows.withColumn("_past", F.coalesce(F.transform("_seen", lambda x: x["_v"]), F.array().cast("array<double>")))
    mean = lambda xs: F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))
    rows = rows.withColumn("past_n", F.size("_past")).withColumn("past_mean", mean(F.col("_past")))
    if short == "substitute":
        rows = rows.withColumn("_past", F.when(F.col("past_n") > 0, F.concat("_past", F.array_repeat("past_mean", F.greatest(F.lit(past) - F.col("past_n"), F.lit(0))))).otherwise(F.col("_past")))
    m, v, zero = F.col("past_mean"), F.col(value).cast("double"), F.lit(0.0)
    sd = F.sqrt(F.try_divide(F.aggregate("_past", zero, lambda a, x: a + (x - m) * (x - m)), F.size("_past") - 1))
    last = F.get("_past", F.lit(0))
    ratio = lambda a, b: F.when(m.isNotNull(), F.coalesce(F.try_divide(a, b), zero))
    out = rows.withColumns({"deviation_abs": v - m, "deviation_pct": ratio((v - m) * 100, F.abs(m)), "z_score": ratio(v - m, sd), "rate_of_change_abs": v - last, "rate_of_change_pct": ratio((v - last) * 100, F.abs(last))})

    def broken(bounds: dict | None) -> Column:
        tests = [_BREAKS[op](F.col(name), F.lit(float(x))) for name, b in (bounds or {}).items() for op, x in b.items() if x is not None]
        return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))

    level = F.when(v.isNull(), 1).when((F.col("past_n") < past) & F.lit(short == "error"), 2).when(F.col("past_n") == 0, codes[none]).when(broken(error), 2).when(broken(warning), 1).otherwise(0)
    return out.withColumn("severity", level).drop("_t", "_seen", "_past")


def forecast(points: DataFrame, at: str, value: str, by: Sequence[str], target: str, warning: float = 0.8, error: float = 0.95, history: int = 90, least: int = 10, changepoints: int = 10, penalty: float = 0.05, multiplicative: bool = False, collected: str | None = None) -> DataFrame:
    """(by..., actual, yhat, the two bands, severity) of each segment at the partition `target`, forecast from its points before.

    A piecewise-linear trend with weekly and daily Fourier terms where the points allow, fitted by ridge regression; bands from the spread
    of the residuals. Of each segment the newest `history` points take part, of a repeated time the one `collected` last (without
    that column the greatest). Fewer than `least` points pass.
    """
    import numpy as np

    t = F.unix_seconds(F.col(at).cast("timestamp"))
    goal = F.unix_seconds(F.lit(target).cast("timestamp"))
    order = F.col(collected if collected else value).alias("_o")
    rows = points.select(*by, t.alias("t"), F.col(value).cast("double").alias("y"), goal.alias("goal"), order).where("t <= goal and y is not null")
    rows = rows.groupBy(*by, "t", "goal").agg(F.max_by("y", F.struct("_o", "y")).alias("y"))
    newest = Window.partitionBy(*by).orderBy(F.col("t").desc())
    rows = rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= history + 1).drop("_k")
    z = {p: float(np.sqrt(2) * _erfinv(p)) for p in (warning, error)}

    def design(x: np.ndarray, start: float, span: float, periods: list[float]) -> np.ndarray:
        u = (x - start) / span
        knots = np.linspace(0, 0.8, changepoints + 2)[1:-1]
        cols = [np.ones_like(u), u, *[np.maximum(u - k, 0) for k in knots]]
        cols += [f(2 * np.pi * k * x / p) for p in periods for k in (1, 2, 3) for f in (np.sin, np.cos)]
        return np.stack(cols, axis=1)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        goal = pdf["goal"].iloc[0]
        now, past = pdf[pdf["t"] == goal], pdf[pdf["t"] < goal].sort_values("t")
        actual = float(now["y"].iloc[0]) if len(now) else None
        out = dict(zip(by, key)) | {"actual": actual, "yhat": None, "warning_low": None, "warning_high": None, "error_low": None, "error_high": None, "severity": 0}
        if len(past) < max(least, 2):
            return pd.DataFrame([out])
        x, y = past["t"].to_numpy(float), past["y"].to_numpy(float)
        log = multiplicative and (y > 0).all()
        y = np.log(y) if log else y
        span, gap = max(x[-1] - x[0], 1.0), np.median(np.diff(x))
        periods = [p for p in (86400.0, 604800.0) if gap <= p / 4 and span >= 2 * p]
        a = design(x, x[0], span, periods)
        ridge = np.r_[1e-9, 1e-9, np.full(changepoints, 1 / penalty), np.full(a.shape[1] - 2 - changepoints, 0.1)]
        w = np.linalg.solve(a.T @ a + np.diag(ridge), a.T @ y)
        sd = float(np.std(y - a @ w))
        yhat = (design(np.array([float(goal)]), x[0], span, periods) @ w)[0]
        back = np.exp if log else (lambda v: v)
        bands = {f"{name}_{side}": float(back(yhat + sign * z[p] * sd)) for name, p in (("warning", warning), ("error", error)) for side, sign in (("low", -1), ("high", 1))}
        outside = lambda n: actual is not None and not bands[f"{n}_low"] <= actual <= bands[f"{n}_high"]
        return pd.DataFrame([out | bands | {"yhat": float(back(yhat)), "severity": 2 if outside("error") else int(outside("warning"))}])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "actual double, yhat double, warning_low double, warning_high double, error_low double, error_high double, severity int"])
    return rows.groupBy(*by).applyInPandas(fit, schema)


def _erfinv(p: float) -> float:
    """The inverse error function, by bisection."""
    import math

    low, high = 0.0, 6.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid) < p else (low, mid)
    return low


def redact(columns: Sequence[str], deny: Sequence[str] = (), allow: Sequence[str] | None = None) -> list[str]:
    """Column names with those not to be shown as ***: denied ones, and all but the allowed where an allow list is given."""
    return [c if c not in deny and (allow is None or c in allow) else "***" for c in columns]
