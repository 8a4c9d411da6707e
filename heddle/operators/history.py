"""The metric history: an append-only table of results, its reads, tombstones, replay and reports.

Every read ranks the versions of a key first and drops tombstones and NULLs afterwards, so that a newer tombstone hides what is older.
All reads work on whole tables with windows by key; none loops over keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, dataset_name string, table_name string, record_type string, metric_name string, metric_value double, dimension_value string, "
    "partition_ts timestamp, run_timestamp timestamp, collected_at timestamp, validated_at timestamp, validation_name string, validation_type string, "
    "validation_status string, validation_message string, details_json string, is_active string"
)


def append_history(rows: DataFrame, path: str) -> DataFrame:
    """Append rows to the history at `path`, strict about its schema: an unknown column or one that does not cast is an error. Returns the history."""
    spark = rows.sparkSession
    target = spark.createDataFrame([], SCHEMA).schema
    if unknown := sorted(set(rows.columns) - set(target.names)):
        raise ValueError(f"not in the history's schema: {unknown}")
    default = {"is_active": F.lit("true")}
    cols = [(F.col(f.name) if f.name in rows.columns else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in target]
    rows.select(*cols).write.mode("append").parquet(path)
    return spark.read.schema(target).parquet(path)


def _first(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _alive(rows: DataFrame, values: bool = True) -> DataFrame:
    rows = rows.where(F.coalesce("is_active", F.lit("true")) == "true")
    return rows.where(F.col("metric_value").isNotNull()) if values else rows


def _newest() -> list[Column]:
    """The latest run first; of one run a validation before what was collected."""
    return [F.col("run_timestamp").desc(), (F.col("record_type") == "validation").desc()]


def _scope(history: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        history = history.where(F.col(name).eqNullSafe(F.lit(value)))
    return history


def metric_history(history: DataFrame, step_seconds: int | None = None, limit: int | None = None, **equal) -> DataFrame:
    """The value of each metric, segment and partition as its latest run has it; with a step, the latest of each bucket of run time.

    `limit` keeps the newest runs of each metric and segment. `equal` narrows to values of columns, NULL-safe.
    """
    key = ["table_name", "metric_name", "dimension_value"]
    rows = _scope(history, **equal).where(F.col("run_timestamp").isNotNull())
    rows = _alive(_first(rows, [*key, "partition_ts"], _newest()))
    if step_seconds:
        rows = rows.withColumn("_b", F.floor(F.unix_seconds("run_timestamp") / step_seconds))
        rows = _first(rows, [*key, "_b"], _newest()).drop("_b")
    if limit is not None:
        w = Window.partitionBy(*key).orderBy(F.col("run_timestamp").desc(), F.col("partition_ts").desc())
        rows = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")
    return rows


def history_at(history: DataFrame, anchors: DataFrame, **equal) -> DataFrame:
    """The values at the partitions that `anchors` (partition_ts) lists."""
    rows = _scope(history, **equal).join(anchors.select("partition_ts").distinct(), "partition_ts", "left_semi")
    order = [*_newest(), F.coalesce("collected_at", "run_timestamp").desc()]
    return _alive(_first(rows, ["table_name", "metric_name", "dimension_value", "partition_ts"], order))


def collected_at_partition(history: DataFrame, partition_ts: Column) -> DataFrame:
    """What was collected at one partition: a row a metric and segment."""
    rows = history.where((F.col("record_type") == "collection") & (F.col("partition_ts") == partition_ts))
    return _alive(_first(rows, ["table_name", "metric_name", "dimension_value"], [F.col("run_timestamp").desc(), F.coalesce("collected_at", "run_timestamp").desc()]))


def validations_at_partition(history: DataFrame, dataset: str, prefix: str, partition_ts: Column) -> DataFrame:
    """The latest verdicts of a validation, or of those named prefix.*, at one partition. The prefix is text, not a pattern."""
    named = (F.col("validation_name") == prefix) | F.col("validation_name").startswith(f"{prefix}.")
    rows = history.where((F.col("record_type") == "validation") & (F.col("dataset_name") == dataset) & named & (F.col("partition_ts") == partition_ts))
    return _alive(_first(rows, ["validation_name", "metric_name", "dimension_value"], [F.col("run_timestamp").desc()]), values=False)


def replay(history: DataFrame, asked: DataFrame, validate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(dataset_name, partition_ts, validation_name, metric_name, dimension_value, severity, message, from_cache) of the validations asked for.

    `asked` has dataset_name, validation_name and partition_ts. Where the history has verdicts of that name, or of name.*, at that
    partition, the latest of each are given back; what it has none of goes to `validate`, which takes such rows and returns the columns
    above but from_cache. A status that is none of PASS, WARNING and ERROR counts as a warning. Without a partition all is validated.
    """
    keys = ["dataset_name", "partition_ts"]
    a = asked.select("dataset_name", F.col("validation_name").alias("_base"), "partition_ts").distinct()
    rows = history.where("record_type = 'validation' and partition_ts is not null")
    named = (F.col("validation_name") == F.col("_base")) | F.col("validation_name").startswith(F.concat("_base", F.lit(".")))
    held = _first(rows.join(a, keys).where(named), [*keys, "_base", "validation_name", "metric_name", "dimension_value"], [F.col("run_timestamp").desc(), F.col("run_id").desc()])
    held = _alive(held, values=False)
    code = F.when(F.col("validation_status") == "PASS", 0).when(F.col("validation_status") == "ERROR", 2).otherwise(1)
    kept = held.select(*keys, "validation_name", "metric_name", "dimension_value", code.alias("severity"), F.col("validation_message").alias("message"), F.lit(True).alias("from_cache"))
    there = held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_base").alias("_there")).distinct()
    missing = a.join(there, (F.col("dataset_name") == F.col("_dataset_name")) & (F.col("partition_ts") == F.col("_partition_ts")) & (F.col("_base") == F.col("_there")), "left_anti")
    made = validate(missing.select("dataset_name", F.col("_base").alias("validation_name"), "partition_ts"))
    return kept.unionByName(made.select(*kept.columns[:-1]).withColumn("from_cache", F.lit(False)))


def latest_runs(history: DataFrame) -> DataFrame:
    """The newest row of each dataset; a dataset whose newest row is a tombstone has none."""
    newest = history.groupBy("dataset_name").agg(F.max_by(F.struct(*history.columns), F.struct("run_timestamp", "run_id")).alias("_r"))  # a row a dataset and task is shuffled
    return _alive(newest.select("_r.*"), values=False)


def validation_history(history: DataFrame, keys: DataFrame, limit: int = 1) -> DataFrame:
    """The newest `limit` verdicts of each key (dataset_name, validation_name, metric_name, dimension_value), NULLs as values."""
    if limit < 1:
        raise ValueError("limit is at least 1")
    names = ["dataset_name", "validation_name", "metric_name", "dimension_value"]
    k = keys.select(*[F.col(c).alias(f"_{c}") for c in names]).distinct()
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = history.where("record_type = 'validation'").join(k, on, "left_semi")
    order = [F.col("run_timestamp").desc(), F.col("validated_at").desc(), F.col("run_id").desc()]
    rows = _alive(_first(rows, [*names, "partition_ts"], order), values=False)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where(F.col("rank") <= limit)


def health_data(history: DataFrame, now: Column, days: int = 30, collection: bool = False) -> DataFrame:
    """The rows of the last days, one a natural key."""
    rows = history.where(F.col("run_timestamp") >= now.cast("timestamp") - F.make_interval(days=F.lit(days)))
    rows = _first(rows, ["dataset_name", "validation_name", "metric_name", "partition_ts", "dimension_value"], _newest())
    kinds = ["validation", "collection"] if collection else ["validation"]
    return _alive(rows, values=False).where(F.col("record_type").isin(kinds))


def health_report(rows: DataFrame, offenders: int = 10) -> DataFrame:
    """(section, key, total, pass, warning, error, internal_error, pass_rate) for summary, dataset, type, day and the worst offenders.

    One aggregation by dataset, type and day; the sections are sums of it. Rates have one decimal. Internal errors are errors as well.
    """
    status = F.upper(F.coalesce("validation_status", F.lit("")))
    internal = F.coalesce(F.get_json_object("details_json", "$.internal_failure") == "true", F.lit(False))
    base = rows.groupBy(F.coalesce("dataset_name", F.lit("unknown")).alias("dataset"), F.coalesce("validation_type", F.lit("unknown")).alias("type"), F.date_format("run_timestamp", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(status == s).alias(s.lower()) for s in ("PASS", "WARNING", "ERROR")], F.count_if((status == "ERROR") & internal).alias("internal_error")
    )
    parts = F.array(F.struct(F.lit("summary").alias("section"), F.lit("").alias("key")), *[F.struct(F.lit(s).alias("section"), F.col(s).alias("key")) for s in ("dataset", "type", "day")])
    counts = ["total", "pass", "warning", "error", "internal_error"]
    out = base.select(F.inline(parts), *counts).where("key is not null").groupBy("section", "key").agg(*[F.sum(c).alias(c) for c in counts])
    worst = out.where("section = 'dataset' and error > 0").orderBy(F.col("error").desc(), "key").limit(offenders).withColumn("section", F.lit("offender"))
    return out.unionByName(worst).withColumn("pass_rate", F.round(F.col("pass") * 100 / F.greatest("total", F.lit(1)), 1))


def tombstones(history: DataFrame, now: Column, note: str | None = None, **equal) -> DataFrame:
    """Rows to append that take back every active row of the scope: newer than what they hide, by a millisecond where that is in the future."""
    key = ["dataset_name", "table_name", "metric_name", "dimension_value", "partition_ts", "record_type", "validation_name"]
    rows = _alive(_first(_scope(history, **equal), key, _newest()), values=False)
    now = now.cast("timestamp")
    later = F.col("run_timestamp") + F.expr("interval 1 millisecond")
    newer = F.when(F.col("run_timestamp") >= now, later).otherwise(now)
    return rows.withColumns({"run_timestamp": newer, "is_active": F.lit("false"), "details_json": F.to_json(F.struct(F.lit(note).alias("note"))), "metric_value": F.lit(None).cast("double")})


def missing_at(expected: DataFrame, history: DataFrame, partition_ts: Column) -> DataFrame:
    """The expected (table_name, metric_name, dimension_value) that were not collected at a partition: none means that it can be replayed."""
    have = collected_at_partition(history, partition_ts)
    on = F.lit(True)
    for c in ("table_name", "metric_name", "dimension_value"):
        on = on & F.col(f"e.{c}").eqNullSafe(F.col(f"h.{c}"))
    return expected.alias("e").join(have.alias("h"), on, "left_anti")


def to_alert(results: DataFrame, history: DataFrame, suppress: bool = True) -> DataFrame:
    """Results with what is not a pass, less those of the same severity as the verdict before; grouped by severity and base name for one message each."""
    names = ["dataset_name", "validation_name", "metric_name", "dimension_value"]
    bad = results.where("validation_status <> 'PASS'")
    if suppress:
        before = validation_history(history, bad).select(*[F.col(c).alias(f"_{c}") for c in names], F.col("validation_status").alias("_before"))
        on = F.lit(True)
        for c in names:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        bad = bad.join(before, on, "left").where(~F.col("validation_status").eqNullSafe(F.col("_before")))
    base = F.substring_index("validation_name", ".", 1)
    return bad.groupBy("dataset_name", "validation_status", base.alias("base_name")).agg(F.count(F.lit(1)).alias("n"), F.min("validation_name").alias("example"))


def metric_series(points: DataFrame, at: str, value: str, interval: str, by: Sequence[str] = (), how: str = "mean") -> DataFrame:
    """Values by time interval and group, as monitoring charts ask for them: mean, sum, count, min, max or a percentile such as p95."""
    v = F.col(value)
    made = {"mean": F.avg(v), "sum": F.sum(v), "count": F.count(v), "min": F.min(v), "max": F.max(v)}
    agg = made[how] if how in made else F.percentile(v, float(how[1:]) / 100)
    return points.groupBy(F.window(at, interval).alias("_w"), *by).agg(agg.alias("value")).select(F.col("_w.start").alias("at"), *by, "value")
