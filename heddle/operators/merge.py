"""Merge, slowly changing dimensions and change feeds over plain tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _need(df: DataFrame, cols: Sequence[str], name: str) -> None:
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"{name} lacks {missing}")


def merge_partitions(base: DataFrame, incremental: DataFrame, keys: Sequence[str], partitions: Sequence[str] = (), allow: Sequence[str] | None = None, deny: Sequence[str] = (), carry: bool = False, extra: bool = True, extra_deny: Sequence[str] = (), delete_when: Column | None = None) -> DataFrame:
    """The rows of the touched partitions after an upsert.

    Columns in `deny`, or outside `allow`, keep their old value where a row is updated. Columns of the base that the increment lacks are
    kept on updated rows with `carry`, else NULL there; untouched rows keep them. Columns of the increment that the base lacks are added
    with `extra`, but for those in `extra_deny`; untouched rows have NULL there. Rows of the increment for which `delete_when` is true
    take their key away. Untouched partitions are not read: the base is cut to the increment's partitions by a semi-join.
    """
    for df, name in ((base, "base"), (incremental, "incremental")):
        _need(df, [*keys, *partitions], name)
    order = base.columns
    if partitions:
        base = base.join(incremental.select(*partitions).distinct(), list(partitions), "left_semi")
    more = [c for c in incremental.columns if c not in base.columns and c not in extra_deny] if extra else []
    held = [c for c in base.columns if c not in keys and (c in deny or allow is not None and c not in allow)]
    new = incremental.select(*[F.col(c).alias(f"_n_{c}") if c not in keys else F.col(c) for c in incremental.columns], F.lit(True).alias("_new"), (delete_when if delete_when is not None else F.lit(False)).alias("_gone"))
    both = base.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer").where(~F.coalesce("_gone", F.lit(False)))

    def pick(c: str) -> Column:
        if f"_n_{c}" not in new.columns:
            return F.col(c) if carry else F.when(F.col("_new").isNull(), F.col(c))
        return F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & F.lit(c in held)), F.col(c)).otherwise(F.col(f"_n_{c}"))

    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in order], *[F.col(f"_n_{c}").alias(c) for c in more])


def merge_into(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Update the matched rows' columns `update` (all if None) and insert the rest; a key twice in the source is an error when rows are read.

    Rows with a NULL key match nothing and are inserted, however many there are.
    """
    update = [c for c in source.columns if c not in keys] if update is None else list(update)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    one = source.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(f"_s_{c}") for c in source.columns if c not in keys])
    one = one.withColumn("_hit", F.when(F.col("_c") > 1, F.raise_error(F.lit("more than one source row matches a key")).cast("boolean")).otherwise(True)).drop("_c")
    both = target.withColumn("_old", F.lit(True)).join(one, list(keys), "full_outer")
    take = lambda c: F.when(F.col("_hit") & (F.col("_old").isNull() | F.lit(c in update)), F.col(f"_s_{c}")).otherwise(F.col(c))
    merged = both.select(*[F.col(c) if c in keys or f"_s_{c}" not in one.columns else take(c).alias(c) for c in target.columns])
    return merged.unionByName(source.where(~whole).select(*[c for c in source.columns if c in target.columns]), allowMissingColumns=True)


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows for which the condition is true get the values; unknown counts as false."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def scd2(current: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], as_of: str, start: str = "start_date", end: str = "end_date", flag: str = "is_current") -> DataFrame:
    """Type-2 history: changed current rows end on `as_of`, new versions and new keys start on it. NULLs compare as values."""
    new = source.select(*[F.col(c).alias(f"_s_{c}") for c in source.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    changed = F.lit(False)
    for c in tracked:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    joined = current.where(flag).withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), on, "full_outer")
    day = F.lit(as_of).cast("date")
    moved = F.coalesce(F.col("_new") & changed & F.col("_old").isNotNull(), F.lit(False))
    kept = joined.where("_old").select(*[F.when(moved, day).otherwise(F.col(c)).alias(c) if c == end else (F.col(flag) & ~moved).alias(c) if c == flag else F.col(c) for c in current.columns])
    fresh = joined.where(moved | F.col("_old").isNull()).select(*[day.alias(c) if c == start else F.lit(None).cast("date").alias(c) if c == end else F.lit(True).alias(c) if c == flag else F.col(f"_s_{c}").alias(c) for c in current.columns])
    return current.where(~F.col(flag)).unionByName(kept).unionByName(fresh)


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """insert, delete, update_preimage and update_postimage rows between two versions."""
    cols = [c for c in after.columns if c not in keys]
    old = before.select(*keys, F.struct(*cols).alias("_b"))
    new = after.select(*keys, F.struct(*cols).alias("_a"))
    both = old.join(new, list(keys), "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    kind = lambda name, col: F.struct(F.lit(name).alias("_change_type"), F.col(col).alias("r"))
    events = F.when(F.col("_b").isNull(), F.array(kind("insert", "_a"))).when(F.col("_a").isNull(), F.array(kind("delete", "_b"))).otherwise(F.array(kind("update_preimage", "_b"), kind("update_postimage", "_a")))
    rows = both.select(*keys, F.explode(events).alias("e"))
    return rows.select(*keys, "e.r.*", "e._change_type", F.lit(version).alias("_commit_version"))


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """Inner join on a skewed key: the large side's rows are dealt to salts, the small side is copied to each."""
    l = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    r = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [key, "_salt"]).drop("_salt")


def mask(df: DataFrame, patterns: dict[str, str], share: float = 0.5) -> DataFrame:
    """Mask string columns of which at least `share` of the values that are not null fit one of the patterns; one pass for all columns."""
    names = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not names:
        return df
    any_of = lambda c: F.lit(False) if not patterns else F.coalesce(F.greatest(*[F.col(c).rlike(p).cast("int") for p in patterns.values()], F.lit(0)), F.lit(0)) == 1
    hits = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), any_of(c).cast("double"))).alias(c) for c in names]).first()
    return df.withColumns({c: F.mask(F.col(c)) for c in names if (hits[c] or 0) >= share})
