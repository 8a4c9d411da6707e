"""One entry to the data-quality operators: collect, validate, remember, report."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import checks, history, lifecycle, models, quality

#: Channels by name: each is given the grouped alerts of a run.
NOTIFIERS: dict[str, Callable[[DataFrame], None]] = {}

_RESULT = ["dataset_name", "validation_name", "validation_type", "metric_name", "dimension_value", "actual_value", "severity"]


def notifier(name: str):
    def add(f):
        NOTIFIERS[name] = f
        return f

    return add


class Quality:
    """Checks of datasets whose results are appended to a history and read back from it.

    A configuration is {dataset, source (a reader of heddle.sources) or sql, at, partition_ts, step, metrics {name: SQL expression}, dims,
    rules [{name, metric, warning, error}], drift [{name, metric, past, warning, error}], trend [{name, metric}], slo {column, warning, error}}.
    """

    def __init__(self, spark: SparkSession, history_path: str, now: str | None = None):
        self.spark, self.path = spark, history_path
        self.now = F.lit(now).cast("timestamp") if now else F.current_timestamp()

    def history(self) -> DataFrame:
        from heddle.sources.tables import fs_of

        p, fs = fs_of(self.spark, self.path)
        schema = self.spark.createDataFrame([], history.SCHEMA).schema
        return self.spark.read.schema(schema).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def frame(self, config: dict) -> DataFrame:
        from heddle.sources import readers

        source = dict(config.get("source", {}))
        kind, options = source.pop("kind", None), source.pop("options", {})
        df = self.spark.sql(config["sql"]) if "sql" in config else readers.read(self.spark, kind, **source, **options)
        return df.where(config["filter"]) if config.get("filter") else df

    def collect(self, df: DataFrame, config: dict, anchors: Sequence | None = None) -> DataFrame:
        """(partition_ts, dimension_value, metric_name, metric_value) of one partition, or of all anchors in one grouping."""
        made = {n: F.expr(e) for n, e in config["metrics"].items()}
        dims = list(config.get("dims", []))
        points = anchors or lifecycle.anchors(config["partition_ts"])
        rows = lifecycle.backfill(df, config["at"], points, made, config.get("step", "P1D"), dims)
        segment = quality.segment_key(dims) if dims else F.lit(None).cast("string")
        return rows.select("partition_ts", segment.alias("dimension_value"), "metric_name", "metric_value")

    def validate(self, df: DataFrame, config: dict) -> DataFrame:
        """The verdicts of a partition, without a write."""
        got, at = self.collect(df, config).persist(), F.lit(config["partition_ts"]).cast("timestamp")
        name, parts = F.lit(config["dataset"]).alias("dataset_name"), []
        if config.get("rules"):
            checks.check_pair("aggregation", "threshold")
            out = checks.threshold(got, config["rules"])
            parts.append(out.select(name, "validation_name", F.lit("threshold").alias("validation_type"), "metric_name", "dimension_value", "actual_value", "severity"))
        past = history.metric_history(self.history(), table_name=config["dataset"]).select("partition_ts", "dimension_value", "metric_name", "metric_value")
        series = past.where(F.col("partition_ts") < at).unionByName(got)
        for rule in config.get("drift", []):
            own = series.where(F.col("metric_name") == rule["metric"])
            out = checks.drift(own, "partition_ts", "metric_value", config.get("step", "P1D"), ["metric_name", "dimension_value"], rule.get("past", 3), warning=rule.get("warning"), error=rule.get("error")).where(F.col("partition_ts") == at)
            parts.append(out.select(name, F.lit(f"{rule['name']}.{rule['metric']}").alias("validation_name"), F.lit("drift").alias("validation_type"), "metric_name", "dimension_value", F.col("metric_value").alias("actual_value"), "severity"))
        for rule in config.get("trend", []):
            out = checks.forecast(series.where(F.col("metric_name") == rule["metric"]), "partition_ts", "metric_value", ["metric_name", "dimension_value"], config["partition_ts"], **{k: rule[k] for k in ("warning", "error", "history", "least", "penalty") if k in rule})
            parts.append(out.select(name, F.lit(f"{rule['name']}.{rule['metric']}").alias("validation_name"), F.lit("trend").alias("validation_type"), "metric_name", "dimension_value", F.col("actual").alias("actual_value"), "severity"))
        if slo := config.get("slo"):
            out = checks.slo(checks.recency(df, slo["column"]), self.now, slo.get("warning"), slo.get("error"))
            parts.append(out.select(name, F.lit("slo").alias("validation_name"), F.lit("slo").alias("validation_type"), F.lit("age_seconds").alias("metric_name"), F.lit(None).cast("string").alias("dimension_value"), F.col("age_seconds").cast("double").alias("actual_value"), "severity"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*_RESULT)

    def run(self, config: dict, notify: bool = True, suppress: bool = False) -> dict[str, int]:
        """Collect, validate, append both to the history, tell the notifiers; raises ValidationFailed on an error, after all is written."""
        df, run_id = self.frame(config), uuid.uuid4().hex
        common = {"run_id": F.lit(run_id), "dataset_name": F.lit(config["dataset"]), "table_name": F.lit(config["dataset"]), "run_timestamp": self.now}
        results = self.validate(df, config).persist()
        before = self.history()
        status = F.when(F.col("severity") == 2, "ERROR").when(F.col("severity") == 1, "WARNING").otherwise("PASS")
        verdicts = results.withColumns(common | {"record_type": F.lit("validation"), "validation_status": status, "metric_value": F.col("actual_value"), "partition_ts": F.lit(config["partition_ts"]).cast("timestamp"), "validated_at": self.now}).drop("severity", "actual_value")
        if notify and NOTIFIERS:
            alerts = history.to_alert(verdicts, before, suppress)
            for tell in NOTIFIERS.values():
                tell(alerts)
        found = self.collect(df, config).withColumns(common | {"record_type": F.lit("collection"), "collected_at": self.now})
        history.append_history(found.unionByName(verdicts, allowMissingColumns=True), self.path)
        try:
            return lifecycle.outcome(results)
        finally:
            results.unpersist()

    def backfill(self, config: dict, anchors: Sequence) -> DataFrame:
        """Collect all anchors at once, append them, and tell what changed: (partition_ts, metric_name, dimension_value, old, new, state)."""
        df = self.frame(config)
        new = self.collect(df, config, anchors)
        points = self.spark.createDataFrame([(a,) for a in anchors], "partition_ts timestamp")
        old = history.history_at(self.history(), points, table_name=config["dataset"]).select("partition_ts", "metric_name", "dimension_value", "metric_value")
        diff = lifecycle.backfill_diff(new, old, ["partition_ts", "metric_name", "dimension_value"]).persist()
        diff.count()
        rows = new.withColumns({"run_id": F.lit(uuid.uuid4().hex), "dataset_name": F.lit(config["dataset"]), "table_name": F.lit(config["dataset"]), "record_type": F.lit("collection"), "run_timestamp": self.now, "collected_at": self.now})
        history.append_history(rows, self.path)
        return diff

    def deactivate(self, note: str | None = None, **scope) -> int:
        """Take back the active rows of a scope; how many."""
        dead = history.tombstones(self.history(), self.now, note, **scope).persist()
        n = dead.count()
        if n:
            history.append_history(dead, self.path)
        return n

    def health_report(self, days: int = 30) -> DataFrame:
        return history.health_report(history.health_data(self.history(), self.now, days))

    def write_audit_publish(self, df: DataFrame, target: str, staging: str, config: dict, **options) -> dict:
        return lifecycle.write_audit_publish(df, target, staging, lambda staged: self.validate(staged, config), **options)

    def profile(self, df: DataFrame, **options) -> DataFrame:
        return quality.profile(df, **options)

    def shape_check(self, df: DataFrame, at: str, anchor: str, step: str, columns: Sequence[str], **options) -> DataFrame:
        """The anomaly check over the slice at the anchor and those before it; the slice column itself takes no part."""
        return models.shape_check(checks.slices(df, at, anchor, step), columns, exclude=[at, *options.pop("exclude", ())], **options)

    def pattern_check(self, df: DataFrame, at: str, anchor: str, step: str, columns: Sequence[str], **options) -> dict:
        return models.pattern_check(checks.slices(df, at, anchor, step), columns, exclude=[at, *options.pop("exclude", ())], **options)


def check_config(config: dict) -> list[str]:
    """What is wrong with a configuration; nothing for a good one."""
    wrong = [f"{k} is missing" for k in ("dataset", "at", "partition_ts", "metrics") if not config.get(k)]
    if "sql" not in config and "source" not in config:
        wrong.append("sql or source is missing")
    known = set(config.get("metrics") or {})
    for kind in ("rules", "drift", "trend"):
        wrong += [f"{kind}: metric {r.get('metric')!r} is not collected" for r in config.get(kind, []) if r.get("metric") not in known]
    if config.get("step"):
        try:
            checks.step_seconds(config["step"])
        except ValueError as e:
            wrong.append(str(e))
    if not any(config.get(k) for k in ("rules", "drift", "trend", "slo")):
        wrong.append("nothing to validate")
    return wrong
