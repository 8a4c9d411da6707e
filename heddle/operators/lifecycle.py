"""Runs around validations: backfill over many partitions at once, selectors, write-audit-publish, outcomes, acceptance, layers of dependants."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import step_seconds

MOST_ANCHORS = 10_000


class ValidationFailed(RuntimeError):
    """A run has results of severity 2."""

    def __init__(self, results: list):
        super().__init__(f"{len(results)} validations failed: {[r['validation_name'] for r in results][:10]}")
        self.results = results


class InternalFailure(RuntimeError):
    """A run could not be carried out; not a finding about data."""


def outcome(results: DataFrame, most: int = 1000) -> dict[str, int]:
    """Counts by severity; raises ValidationFailed if any is an error (up to `most` of them are named)."""
    counts = {r[0]: r[1] for r in results.groupBy("severity").count().collect()}
    if counts.get(2):
        raise ValidationFailed([r.asDict() for r in results.where("severity = 2").limit(most).collect()])
    return {"pass": counts.get(0, 0), "warning": counts.get(1, 0), "error": 0}


def anchors(start: str, end: str | None = None, step: str = "P1D", listed: Sequence[str] = ()) -> list[dt.datetime]:
    """Partitions of a backfill: one, a list, or from start to end by step; more than 10,000 are an error."""
    if listed:
        out = sorted({dt.datetime.fromisoformat(x) for x in listed})
    else:
        a, z, s = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end or start), step_seconds(step)
        n = int((z - a).total_seconds() // s) + 1
        if n > MOST_ANCHORS:
            raise ValueError(f"{n} anchors; at most {MOST_ANCHORS}")
        out = [a + dt.timedelta(seconds=s * k) for k in range(max(n, 0))]
    if not out or len(out) > MOST_ANCHORS:
        raise ValueError(f"{len(out)} anchors; 1 to {MOST_ANCHORS}")
    return out


def backfill(df: DataFrame, at: str, points: Sequence[dt.datetime], metrics: dict[str, Column], step: str = "P1D", dims: Sequence[str] = ()) -> DataFrame:
    """(partition_ts, dims..., metric_name, metric_value) of every anchor in one grouping: partitions are a key, not a loop of runs."""
    spark, s = df.sparkSession, step_seconds(step)
    wanted = spark.createDataFrame([(p,) for p in points], "partition_ts timestamp")
    origin = int(points[0].replace(tzinfo=dt.timezone.utc).timestamp())
    first = F.timestamp_seconds(F.floor((F.unix_seconds(F.col(at).cast("timestamp")) - origin) / s) * s + origin)
    rows = df.withColumn("partition_ts", first).join(F.broadcast(wanted), "partition_ts", "left_semi")  # at most 10,000 anchors
    wide = rows.groupBy("partition_ts", *dims).agg(*[c.cast("double").alias(f"m{i}") for i, c in enumerate(metrics.values())])
    pairs = [F.struct(F.lit(n).alias("metric_name"), F.col(f"m{i}").alias("metric_value")) for i, n in enumerate(metrics)]
    return wide.select("partition_ts", *dims, F.inline(F.array(*pairs)))


def backfill_diff(new: DataFrame, old: DataFrame, keys: Sequence[str], value: str = "metric_value", rel: float = 1e-9) -> DataFrame:
    """(keys..., old, new, state): refreshed, unchanged (within `rel`), added or missing."""
    n = new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_n"))
    o = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("old"), F.lit(True).alias("_o"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    same = F.col("old").eqNullSafe(F.col("new")) | (F.abs(F.col("old") - F.col("new")) <= rel * F.greatest(F.abs("old"), F.abs("new")))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("refreshed")
    return n.join(o, on, "full_outer").select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], "old", "new", state.alias("state"))


def select(names: Sequence[str], selectors: Sequence[str]) -> list[str]:
    """The names dataset:validation:metric that a selector dataset:validation[:metric] means; * stands for any part. A selector without a match is an error."""
    out = []
    for s in selectors:
        want = s.split(":")
        if not 2 <= len(want) <= 3:
            raise ValueError(f"not a selector: {s!r}")
        hit = [n for n in names if all(a in ("*", b) for a, b in zip(want, n.split(":")))]
        if not hit:
            raise ValueError(f"nothing matches {s!r}")
        out += [n for n in hit if n not in out]
    return out


def write_audit_publish(df: DataFrame, target: str, staging: str, audit: Callable[[DataFrame], DataFrame], mode: str = "overwrite", partition_by: Sequence[str] = (), allow_create: bool = True) -> dict:
    """Stage the frame under `staging`, audit what was written, publish it if no result is an error, and clear the staging either way.

    `audit` gives rows with validation_name and severity. Errors roll back: the target is not touched. Warnings publish.
    """
    from heddle.sources import fs_of, safe_overwrite

    spark, place = df.sparkSession, f"{staging.rstrip('/')}/wap-{uuid.uuid4().hex}"
    path, fs = fs_of(spark, target)
    if not allow_create and not fs.exists(path):
        raise ValueError(f"{target} does not exist")
    try:
        df.write.parquet(place)
        staged = spark.read.schema(df.schema).parquet(place)
        results = audit(staged).select("validation_name", F.col("severity").cast("int").alias("severity")).collect()  # a row a validation
        bad = [r.validation_name for r in results if r.severity == 2]
        if not bad:
            if mode == "overwrite":
                safe_overwrite(staged, target, tuple(partition_by))
            else:
                staged.write.mode(mode).partitionBy(*partition_by).parquet(target)
        return {"published": not bad, "errors": bad, "warnings": [r.validation_name for r in results if r.severity == 1]}
    finally:
        p, f = fs_of(spark, place)
        f.delete(p, True)


def accept(spark: SparkSession, pending_sql: str, zeros: int = 3, attempts: int = 20, wait: float = 0.0) -> str:
    """PASS once a query of what is pending has given 0 so many times in a row, VIOLATED after so many attempts."""
    run = 0
    for _ in range(attempts):
        run = run + 1 if (spark.sql(pending_sql).first()[0] or 0) == 0 else 0
        if run >= zeros:
            return "PASS"
        time.sleep(wait)
    return "VIOLATED"


def layers(needs: dict[str, Sequence[str]]) -> list[list[str]]:
    """Names by level: each after all that it needs. A cycle is an error."""
    left, out = {n: set(d) for n, d in needs.items()}, []
    for d in needs.values():
        for n in d:
            left.setdefault(n, set())
    while left:
        level = sorted(n for n, d in left.items() if not d)
        if not level:
            raise ValueError(f"cycle among {sorted(left)}")
        out.append(level)
        left = {n: d - set(level) for n, d in left.items() if d}
    return out
