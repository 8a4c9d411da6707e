"""Metrics, profiles, rules, verdicts and their history, each planned as one aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_metrics(df: DataFrame, metrics: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(dims..., metric_name, metric_value): all expressions in one aggregation."""
    wide = df.groupBy(*by).agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).alias("metric_value")) for n in metrics])
    return wide.select(*by, F.inline(pairs))


def segment_key(cols: Sequence[str]) -> Column:
    """Compact JSON of the dimensions by lower-cased sorted name; NULL cells read None."""
    parts = [F.concat(F.lit(f'"{c.lower()}":"'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("None")), r'(["\\])', r"\\$1"), F.lit('"')) for c in sorted(cols, key=str.lower)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


_FAMILY = {**dict.fromkeys(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "numeric"), **dict.fromkeys(("string", "varchar", "char"), "text"), "boolean": "boolean", **dict.fromkeys(("timestamp", "timestamp_ntz", "date"), "time")}


def family(kind: str) -> str | None:
    """numeric, text, boolean or time; None for other types."""
    return _FAMILY.get(kind.split("(")[0])


def _stats(c: Column, kind: str, quantiles: Sequence[float]) -> dict[str, Column]:
    total, nulls = F.count(F.lit(1)), F.count_if(c.isNull())
    share = lambda n, of: F.round(F.try_divide(n * 100.0, of), 4)
    out = {"count": total, "null_count": nulls, "null_pct": share(nulls, total)}
    if kind == "numeric":
        d = c.cast("double")
        out |= {"min": F.min(d), "max": F.max(d), "mean": F.avg(d), "stddev": F.stddev(d), "variance": F.variance(d), "skewness": F.skewness(d), "kurtosis": F.kurtosis(d), "approx_distinct": F.approx_count_distinct(c)}
        out |= {"quantiles": F.percentile_approx(d, [float(q) for q in quantiles])} if quantiles else {}
    elif kind == "text":
        n = F.length(c)
        out |= {"min_length": F.min(n), "max_length": F.max(n), "avg_length": F.round(F.avg(n), 2), "approx_distinct": F.approx_count_distinct(c), "empty_count": F.count_if(c == ""), "empty_pct": share(F.count_if(c == ""), total)}
    elif kind == "boolean":
        true = F.sum(c.cast("int"))
        out |= {"true_count": true, "false_count": total - nulls - true, "true_pct": share(true, total - nulls)}
    else:
        out |= {"min": F.unix_seconds(F.min(c).cast("timestamp")), "max": F.unix_seconds(F.max(c).cast("timestamp")), "approx_distinct": F.approx_count_distinct(c)}
    return out


def _wanted(stat: str, override: dict | None, stats: Sequence[str] | None, exclude: Sequence[str]) -> bool:
    """A column's own lists go before the global ones: its include list decides alone, then its exclude list takes away."""
    override = override or {}
    if override.get("stats") is not None:
        return stat in override["stats"]
    if stat in (override.get("exclude") or ()):
        return False
    return stat in stats if stats is not None else stat not in exclude


def profile(df: DataFrame, columns: Sequence[str] | None = None, stats: Sequence[str] | None = None, exclude: Sequence[str] = (), overrides: dict[str, dict] | None = None, quantiles: Sequence[float] = (0.25, 0.5, 0.75), analyzers: Sequence[tuple[str, Callable[[Column], dict[str, Column]]]] = ()) -> DataFrame:
    """(column_name, stat, value) of every numeric, text, boolean and time column, in one aggregation without a shuffle of rows.

    count is of rows; distinct counts and quantiles are approximate (see exact_distinct). Quantiles come as p25 and so on, times as epoch
    seconds. `analyzers` are further (family, function of the column giving named aggregates). `overrides` holds, by column, "stats" and "exclude".
    """
    plan: list[tuple[str, str, Column]] = []
    arrays: list[tuple[str, Column]] = []
    for f in df.schema:
        kind = family(f.dataType.simpleString())
        if kind is None or (columns is not None and f.name not in columns):
            continue
        c = F.col(f"`{f.name}`")
        found = _stats(c, kind, quantiles)
        for of, make in analyzers:
            found |= make(c) if of == kind else {}
        for name, e in found.items():
            if not _wanted(name, (overrides or {}).get(f.name), stats, exclude):
                continue
            if name == "quantiles":
                arrays.append((f"q{len(arrays)}", e))
                plan += [(f.name, f"p{q * 100:g}", F.get(arrays[-1][0], F.lit(i))) for i, q in enumerate(quantiles)]
            else:
                arrays.append((f"s{len(arrays)}", e))
                plan.append((f.name, name, F.col(arrays[-1][0])))
    if not plan:
        return df.sparkSession.createDataFrame([], "column_name string, stat string, value double")
    wide = df.agg(*[e.alias(n) for n, e in arrays])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("stat"), e.cast("double").alias("value")) for c, s, e in plan])))


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, distinct_count): each column is grouped by value, then counted; no task holds the values of a column."""
    one = lambda c: df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.lit(1)).agg(F.count(F.lit(1)).alias("distinct_count")).select(F.lit(c).alias("column_name"), "distinct_count")
    return reduce(DataFrame.unionAll, [one(c) for c in columns])


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(column_name, value, n, rank): the k most frequent values of each column, NULL among them, ties by value; all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    n = df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, count, mean, stddev, min, p25, p50, p75, max) of numeric columns."""
    wide = profile(df, columns, ["null_count", "count", "mean", "stddev", "min", "max", "quantiles"])
    pick = lambda s: F.max(F.when(F.col("stat") == s, F.col("value"))).alias(s)
    out = wide.groupBy("column_name").agg(*[pick(s) for s in ("count", "null_count", "mean", "stddev", "min", "p25", "p50", "p75", "max")])
    return out.withColumn("count", F.col("count") - F.col("null_count")).drop("null_count")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule_name, violations, total): rows for which a rule's condition is true, all rules in one pass. NULL passes."""
    wide = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule_name"), F.col(f"r{i}").alias("violations"), F.col("total").alias("total")) for i, n in enumerate(rules)])))


def unique_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(duplicates): groups of the columns that hold more than one row."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("duplicates"))


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str, nulls_are_orphans: bool = True) -> DataFrame:
    """Rows whose key is in no parent row."""
    left = df if nulls_are_orphans else df.where(F.col(key).isNotNull())
    return left.join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def completeness(df: DataFrame, column: str, least_pct: float = 100) -> DataFrame:
    """(completeness_pct, passed): an empty table is complete."""
    pct = F.coalesce(F.try_divide(F.count(F.col(f"`{column}`")) * 100.0, F.count(F.lit(1))), F.lit(100.0))
    return df.agg(pct.alias("completeness_pct")).withColumn("passed", F.col("completeness_pct") >= least_pct)


# Families of types that a type rule accepts for each other.
_TYPES = {"integer": ["int", "bigint", "smallint", "tinyint", "long"], "float": ["float", "double", "decimal"], "string": ["string", "varchar", "char"], "date": ["date"], "timestamp": ["timestamp"], "boolean": ["boolean", "bool"]}


def type_matches(df: DataFrame, column: str, expected: str, by_name: bool = False) -> bool:
    """Whether the column's type is of the family that `expected` is a member of. Family names themselves count only with `by_name`."""
    actual, expected = dict(df.dtypes)[column].lower(), expected.lower()
    return any((expected in members or by_name and expected == name) and actual.startswith(tuple(members)) for name, members in _TYPES.items())


def schema_drift(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, expected type, actual type or MISSING) of each difference; columns that are not expected are no drift."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    return [(c, kind, actual.get(c, "MISSING")) for c, kind in expected.items() if actual.get(c) != kind]


def volume(current: DataFrame, previous: DataFrame, warn_pct: float, fail_pct: float) -> DataFrame:
    """(current_count, previous_count, diff_pct, status): FAIL or WARN where the change is over its bound; nothing before and something now fails."""
    n = current.agg(F.count(F.lit(1)).alias("current_count")).withColumn("_k", F.lit(1)).join(previous.agg(F.count(F.lit(1)).alias("previous_count")).withColumn("_k", F.lit(1)), "_k").drop("_k")
    diff = F.abs(F.col("current_count") - F.col("previous_count")) * 100.0
    n = n.withColumn("diff_pct", F.try_divide(diff, F.col("previous_count")))
    d = F.coalesce("diff_pct", F.when(F.col("current_count") > 0, float("inf")).otherwise(0.0))
    return n.withColumn("status", F.when(d > fail_pct, "FAIL").when(d > warn_pct, "WARN").otherwise("PASS"))


def sql_rule(df: DataFrame, query: str) -> DataFrame:
    """(cnt, passed) of a query that names the table {table} and gives cnt; zero passes."""
    return df.sparkSession.sql(query.replace("${TABLE}", "{table}"), table=df).select(F.col("cnt").cast("long").alias("cnt"), (F.col("cnt") == 0).alias("passed"))


def _condition(rule: dict) -> Column | None:
    """The condition that a row breaks, for rules on single rows."""
    c, kind = F.col(f"`{rule['column']}`") if "column" in rule else None, rule["type"]
    none = F.lit(False)
    if kind == "not_null":
        return c.isNull()
    if kind == "range":
        low, high = rule.get("min"), rule.get("max")
        return (c < low if low is not None else none) | (c > high if high is not None else none)
    if kind == "pattern":
        return ~c.rlike(rule["pattern"])
    if kind == "value_set":
        return ~c.isin(list(rule["allowed_values"]))
    if kind == "string_length":
        n = F.length(c)
        return (n < rule.get("min_length", 0)) | (n > rule["max_length"] if "max_length" in rule else none)
    if kind == "freshness":
        return F.date_diff(F.lit(rule["as_of"]).cast("date"), c) > rule["max_days"]
    return None


def run_rules(df: DataFrame, rules: Sequence[dict], ask: Callable[[str], str] | None = None) -> DataFrame:
    """(rule_name, type, violations, status, severity, weight) of a table's rules: those on single rows in one aggregation, NULL passing.

    Types: not_null, range, pattern, value_set, string_length, freshness, completeness, unique, duplicate, type_check, sql, llm. A rule
    that cannot be planned, or of an unknown type, is an ERROR and counts as failed in score(). Rules that are not enabled are left out.
    """
    spark, plain, parts = df.sparkSession, [], []
    told = lambda r, v, status: v.select(F.lit(r["name"]).alias("rule_name"), F.lit(r["type"]).alias("type"), F.col("violations").cast("long").alias("violations"), status.alias("status"), F.lit(r.get("severity", "ERROR")).alias("severity"), F.lit(float(r.get("weight", 1))).alias("weight"))
    counted = F.when(F.col("violations") == 0, "PASS").otherwise("FAIL")
    fixed = lambda r, ok, status=None: told(r, spark.range(1).select(F.lit(0 if ok else 1).alias("violations")), F.lit(status or ("PASS" if ok else "FAIL")))
    for r in rules:
        if not r.get("enabled", True):
            continue
        try:
            if (broken := _condition(r)) is not None:
                df.select(broken)
                plain.append((r, broken))  # by place: names may repeat
            elif r["type"] == "completeness":
                done = completeness(df, r["column"], r.get("min_completeness_pct", 100)).select(F.when(F.col("passed"), 0).otherwise(1).alias("violations"))
                parts.append(told(r, done, counted))
            elif r["type"] in ("unique", "duplicate"):
                cols = r.get("columns") or [r["column"]]
                parts.append(told(r, unique_violations(df, cols).select(F.col("duplicates").alias("violations")), counted))
            elif r["type"] == "type_check":
                parts.append(fixed(r, type_matches(df, r["column"], r["expected_type"])))
            elif r["type"] == "sql":
                parts.append(told(r, sql_rule(df, r["sql"]).select(F.col("cnt").alias("violations")), counted))
            elif r["type"] == "llm" and ask:
                parts.append(fixed(r, llm_passes(df, r["column"], r["instruction"], ask)))
            else:
                parts.append(fixed(r, False, "ERROR"))
        except Exception:  # a rule that names what is not there: an error of the rule, told as its status
            parts.append(fixed(r, False, "ERROR"))
    if plain:
        wide = df.agg(*[F.count_if(cond).alias(f"r{i}") for i, (_, cond) in enumerate(plain)])
        rows = [F.struct(F.lit(r["name"]).alias("rule_name"), F.lit(r["type"]).alias("type"), F.col(f"r{i}").alias("violations"), F.when(F.col(f"r{i}") == 0, "PASS").otherwise("FAIL").alias("status"), F.lit(r.get("severity", "ERROR")).alias("severity"), F.lit(float(r.get("weight", 1))).alias("weight")) for i, (r, _) in enumerate(plain)]
        parts.insert(0, wide.select(F.inline(F.array(*rows))))
    if not parts:
        return spark.createDataFrame([], "rule_name string, type string, violations bigint, status string, severity string, weight double")
    return reduce(DataFrame.unionByName, parts)


def table_score(results: DataFrame) -> DataFrame:
    """(score): 100 less the weight of what did not pass, as a share; no rules give 100."""
    failed = F.sum(F.when(F.col("status") != "PASS", F.col("weight")).otherwise(0.0))
    return results.agg(F.coalesce(F.round(100 - F.try_divide(failed, F.sum("weight")) * 100, 2), F.lit(100.0)).alias("score"))


def llm_passes(df: DataFrame, column: str, instruction: str, ask: Callable[[str], str], sample: int = 50) -> bool:
    """Whether a model, given values of the column, answers PASS; anything else fails. `ask` is any function of a prompt."""
    v = F.col(f"`{column}`").cast("string")
    values = [r[0] for r in df.where(v.isNotNull()).select(v.alias("v")).orderBy(F.xxhash64("v"), "v").limit(sample).collect()]  # at most `sample`
    return ask(f"{instruction}\nAnswer PASS or FAIL.\n" + "\n".join(values)).strip().upper() == "PASS"


class GateError(ValueError):
    """Data that a gate does not let through."""


def gate(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """The frame itself, or GateError naming the rules that did not pass."""
    bad = [(r.rule_name, r.violations) for r in run_rules(df, rules).where("status <> 'PASS'").collect()]  # a row a rule
    if bad:
        raise GateError(f"rules not passed: {bad}")
    return df


def score(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(score): 100 less the share of the failed rules' weight."""
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col("rule_name") == name, value).otherwise(w)
    failed = F.sum(F.when(F.col("violations") > 0, w).otherwise(0.0))
    return results.agg(F.round(100 - failed / F.sum(w) * 100, 2).alias("score"))


_OPS = {"min": lambda v, t: v < t, "max": lambda v, t: v > t, "eq": lambda v, t: v != t, "neq": lambda v, t: v == t, "gt": lambda v, t: ~(v > t), "lt": lambda v, t: ~(v < t), "gte": lambda v, t: ~(v >= t), "lte": lambda v, t: ~(v <= t)}


def severity(value: Column, error: dict[str, float] | None = None, warning: dict[str, float] | None = None, empty: int = 1) -> Column:
    """2 error, 1 warning, 0 pass; the error bounds come first; NULL gives `empty`."""
    broken = lambda bounds: F.greatest(*[_OPS[op](value, F.lit(t)).cast("int") for op, t in bounds.items()], F.lit(0)) == 1
    out = F.when(value.isNull(), empty)
    if error:
        out = out.when(broken(error), 2)
    if warning:
        out = out.when(broken(warning), 1)
    return out.otherwise(0)


def latest_history(history: DataFrame, limit: int | None = None) -> DataFrame:
    """Per metric, segment and partition the latest run; tombstones and NULLs go after the ranking, not before it."""
    key = Window.partitionBy("metric_name", "dimension_value", "partition_ts")
    order = key.orderBy(F.col("run_ts").desc(), (F.col("record_type") == "validation").desc())
    rows = history.withColumn("_r", F.row_number().over(order)).where("_r = 1").where(F.coalesce(F.col("is_active"), F.lit("true")) == "true").where(F.col("metric_value").isNotNull()).drop("_r")
    if limit is None:
        return rows
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("metric_name", "dimension_value").orderBy(F.col("partition_ts").desc()))).where(F.col("_k") <= limit).drop("_k")


def exact_quantiles(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float], most: int = 100_000) -> DataFrame:
    """(column_name, quantile, value) of numbers: the least value with at least that share of all values at or below it; NULL and NaN are left out.

    Each quantile has a window of values that holds its rank. A pass over the table counts what lies below the window and in it and sketches
    the latter, which gives a window of some fiftieth, until at most `most` rows or one value are left, or the ends alone hold nearly all; the values left are counted and sorted. Counts are exact,
    so that a sketch that errs costs a pass with a wider window. The driver holds two ends and two counts a quantile.
    """
    x = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in columns}
    asked = [(c, q) for c in columns for q in quantiles]
    counted = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    n = dict(zip(columns, counted))
    open_ = {a: (float("-inf"), float("inf")) for a in asked if n[a[0]]}
    rank = {(c, q): max(1, math.ceil(Decimal(str(q)) * n[c])) for c, q in open_}
    margin, held = dict.fromkeys(open_, 0.01), {}
    inside = lambda a, ends: x[a[0]].between(F.lit(ends[0]), F.lit(ends[1]))
    while open_:
        todo = list(open_)
        wide = df.agg(
            *[F.count_if(x[a[0]] < F.lit(open_[a][0])).alias(f"b{i}") for i, a in enumerate(todo)],
            *[F.count_if(inside(a, open_[a])).alias(f"m{i}") for i, a in enumerate(todo)],
            *[F.kll_sketch_agg_double(F.when(inside(a, open_[a]), x[a[0]]), F.lit(800)).alias(f"s{i}") for i, a in enumerate(todo)],
        )
        grid = F.array(*[F.lit(i / 200) for i in range(201)])
        got = wide.select(*[F.struct(F.col(f"b{i}"), F.col(f"m{i}"), F.when(F.col(f"m{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", grid))) for i in range(len(todo))]).first()
        for a, (below, m, cuts) in zip(todo, got):
            low, high = open_[a]
            if not below < rank[a] <= below + m:
                open_[a], margin[a] = (float("-inf"), float("inf")), margin[a] * 4
                continue
            at = (rank[a] - below) / m
            ends = cuts[max(0, math.floor(200 * (at - margin[a])))], cuts[min(200, math.ceil(200 * (at + margin[a])))]
            if m <= most or low == high or ends == (low, high):
                held[a] = (*open_.pop(a), rank[a] - below)
            else:
                open_[a] = ends
    schema = "column_name string, quantile double, value double"
    if not held:
        return df.sparkSession.createDataFrame([], schema)
    found = F.array(*[F.when(inside(a, (low, high)), F.struct(F.lit(a[0]).alias("column_name"), F.lit(float(a[1])).alias("quantile"), F.lit(k).alias("k"), x[a[0]].alias("value"))) for a, (low, high, k) in held.items()])
    values = df.select(F.inline(F.filter(found, lambda v: v.isNotNull()))).groupBy("column_name", "quantile", "k", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("column_name", "quantile").orderBy("value"))
    return values.withColumn("upto", upto).where("upto >= k").groupBy("column_name", "quantile").agg(F.min("value").alias("value"))
