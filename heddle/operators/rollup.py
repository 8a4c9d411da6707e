"""Profiles that roll up: sketches kept a partition, merged over any span of partitions without another scan of the data.

Kept of each column: rows and nulls, smallest and greatest, mean and squared deviations (numbers), a HyperLogLog sketch of its distinct
values, a KLL sketch of its quantiles (numbers) and a sketch of its frequent values. All but the last three are exact after any merge. The
estimates' errors, with the sizes here: DISTINCT_ERROR of the distinct values (three deviations), RANK_ERROR of all rows in a quantile's
rank (99 %), and nothing for frequent values while a partition has at most TRACKED * 3 / 4 of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import family

LOG_BUCKETS, KLL_SIZE, TRACKED = 14, 800, 4096
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LOG_BUCKETS / 2)
RANK_ERROR = 0.005


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def sketch(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A row for each column and group: (by..., column_name, kind, rows, nulls, least, greatest, mean, deviations, distinct, ranks, top).

    One aggregation of one scan. Numbers that are NaN count as nulls; an empty text is a value; NULL is one of the frequent values. A table without rows gives none, unless there is no `by`.
    """
    kinds = {f.name: family(f.dataType.simpleString()) for f in df.schema}
    parts = []
    for c in columns:
        x, number = _name(c), kinds[c] == "numeric"
        if number and dict(df.dtypes)[c] in ("double", "float"):
            x = F.when(~F.isnan(x), x)
        d = x.cast("double") if number else F.lit(None).cast("double")
        told = x.cast("string")
        parts.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(kinds[c]).alias("kind"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(x.isNull()).alias("nulls"),
                F.min(x).cast("string").alias("least"),
                F.max(x).cast("string").alias("greatest"),
                F.avg(d).alias("mean"),
                (F.var_pop(d) * F.count(d)).alias("deviations"),
                F.hll_sketch_agg(F.concat(F.lit("="), told), F.lit(LOG_BUCKETS)).alias("distinct"),
                (F.kll_sketch_agg_double(d, F.lit(KLL_SIZE)) if number else F.lit(None).cast("binary")).alias("ranks"),
                F.call_function("approx_top_k_accumulate", told, F.lit(TRACKED)).alias("top"),
            ).alias(f"_{len(parts)}")
        )
    wide = df.groupBy(*by).agg(*parts)
    return wide.select(*by, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(parts))])))


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of wider groups, in the same columns: of partitions of a month, of all that is kept."""
    n = F.col("rows") - F.col("nulls")
    number = F.col("kind") == "numeric"
    ends = lambda f, c: F.when(F.first("kind") == "numeric", f(F.when(number, F.col(c).cast("double"))).cast("string")).otherwise(f(F.when(~number, F.col(c))))
    total, mean = F.sum(n), F.sum(n * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), n))
    out = sketches.groupBy(*by, "column_name").agg(
        F.first("kind").alias("kind"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        ends(F.min, "least").alias("least"),
        ends(F.max, "greatest").alias("greatest"),
        mean.alias("mean"),
        (F.sum(F.col("deviations") + n * F.col("mean") * F.col("mean")) - total * mean * mean).alias("deviations"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("ranks", F.lit(KLL_SIZE)).alias("ranks"),
        F.call_function("approx_top_k_combine", F.col("top"), F.lit(TRACKED)).alias("top"),
    )
    return out.withColumn("ranks", F.when(F.col("kind") == "numeric", F.col("ranks")))


def estimates(sketches: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """Sketches as statistics: null_pct, mean, stddev, distinct_count, quantiles (array in the order asked) and top_values (array of item and count)."""
    n = F.col("rows") - F.col("nulls")
    own = [c for c in sketches.columns if c not in ("deviations", "distinct", "ranks", "top")]
    read = F.when(F.col("ranks").isNotNull() & (n > 0), F.transform(F.array(*[F.lit(float(q)) for q in quantiles]), lambda q: q))
    at = F.when(read.isNotNull(), F.kll_sketch_get_quantile_double("ranks", F.array(*[F.lit(float(q)) for q in quantiles])))
    return sketches.select(
        *own,
        F.try_divide(F.col("nulls") * 100.0, "rows").alias("null_pct"),
        F.sqrt(F.greatest(F.try_divide("deviations", n - 1), F.lit(0.0))).alias("stddev"),
        F.hll_sketch_estimate("distinct").alias("distinct_count"),
        at.alias("quantiles"),
        F.call_function("approx_top_k_estimate", F.col("top"), F.lit(top)).alias("top_values"),
    )


def keep(df: DataFrame, columns: Sequence[str], by: Sequence[str], path: str) -> DataFrame:
    """Add the sketches of new partitions to the table of sketches; partitions that are there already are replaced. Returns the table.

    The new partitions' data alone is scanned. The table is partitioned by the groups, and only those that come are written.
    """
    made = sketch(df, columns, by)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)
