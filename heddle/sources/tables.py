"""Writers and table upkeep: write modes, size-targeted writes, versions with manifests, layout, properties."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fs_of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="heddle-")
    return f"{base.rstrip('/')}/heddle/{name}-{uuid.uuid4().hex}"


def insert_into(df: DataFrame, table: str) -> None:
    """Append to a table by its columns' names and types, not by place."""
    from . import align_to_target

    align_to_target(df, df.sparkSession.table(table).schema).write.insertInto(table)


def write_mode(df: DataFrame, path: str, mode: str, keys: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    """CREATE (an error where there is one), APPEND with new columns, OVERWRITE in place of what df may read, or MERGE by keys."""
    from heddle.operators.merge import merge_into

    from . import safe_overwrite

    spark = df.sparkSession
    p, fs = fs_of(spark, path)
    if mode == "CREATE":
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    elif mode == "APPEND":
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
    elif mode == "OVERWRITE":
        safe_overwrite(df, path, tuple(partition_by))
    elif mode == "MERGE":
        if not keys:
            raise ValueError("MERGE needs keys")
        old = spark.read.parquet(path) if fs.exists(p) else df.limit(0)
        safe_overwrite(merge_into(old, df, keys), path, tuple(partition_by))
    else:
        raise ValueError(f"unknown mode {mode!r}")


def write_sized(df: DataFrame, path: str, file_mb: int = 256, mode: str = "overwrite") -> int:
    """Write files of about a size: by the plan's estimate, never more parts than the plan has. Returns the parts.

    Without an estimate the parts stay as they are: a REBALANCE hint lets AQE choose them.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(1, -(-size // (file_mb << 20)))
    if size >= 1 << 50:
        df.hint("rebalance").write.mode(mode).parquet(path)
        return 0
    now = df.rdd.getNumPartitions()
    (df.coalesce(parts) if parts < now else df).write.mode(mode).parquet(path)
    return min(parts, now)


def materialise(df: DataFrame, large_bytes: int = 1 << 30) -> DataFrame:
    """Keep a frame for reuse: in memory and on disk while its estimate is small, else as a reliable checkpoint in the shared folder."""
    from pyspark import StorageLevel

    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= large_bytes:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        return kept
    return df.checkpoint()


def clustered(df: DataFrame, *columns: str) -> DataFrame:
    """Rows laid out by columns for a write: ranges by file, sorted within, so that filters on them skip files and row groups."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def z_order(df: DataFrame, *columns: str, bits: int = 12) -> DataFrame:
    """Rows laid out by the interleaved bits of the columns' ranks in their ranges, so that filters on any of them skip files."""
    low = df.agg(*[F.min(c).cast("double").alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(c).cast("double").alias(f"z{i}") for i, c in enumerate(columns)]).first()
    top, key = (1 << bits) - 1, F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        a, z = low[f"a{i}"] or 0.0, low[f"z{i}"] or 0.0
        rank = F.coalesce(((F.col(c).cast("double") - a) / ((z - a) or 1.0) * top).cast("bigint"), F.lit(0).cast("bigint"))
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(1), b * len(columns) + i))
    return df.withColumn("_z", key).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")


def bucketed(df: DataFrame, table: str, buckets: int, *keys: str) -> DataFrame:
    """A table bucketed and sorted by keys: two such tables of as many buckets join without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def surrogate_keys(df: DataFrame, order: Sequence[str], start: int = 0, name: str = "id") -> DataFrame:
    """Gapless keys after `start` in the order of the business key, ties by all columns: counts by range partition, no single task.

    Ranges are ranked within themselves and moved by the counts before them, a row a range.
    """
    from pyspark.sql import Window

    cols = [*order, *[c for c in df.columns if c not in order]]
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*cols)))
    return ranked.join(F.broadcast(before), "_part").withColumn(name, F.lit(start) + F.col("_before") + F.col("_r")).drop("_part", "_r", "_before")


def set_properties(spark: SparkSession, table: str, values: dict) -> None:
    """Properties of a catalog table; values that are not texts are kept as JSON."""
    pairs = ", ".join("'{}' = '{}'".format(k, (v if isinstance(v, str) else json.dumps(v)).replace("\\", "\\\\").replace("'", "\\'")) for k, v in values.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def unset_properties(spark: SparkSession, table: str, *names: str) -> None:
    spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ({', '.join(repr(n) for n in names)})")


class VersionedTable:
    """A table of immutable data folders and, for each version, a manifest that lists the folders it is made of.

    An append writes the new rows and a manifest, nothing else. Time travel, restore, column changes, compaction, expiry and change feeds
    follow from the manifests. A commit is the creation of the manifest's file, which fails where another writer was first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def versions(self) -> list[int]:
        p, fs = fs_of(self.spark, f"{self.path}/_versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def entry(self, version: int | None = None) -> dict:
        """The manifest: folders, schema, at (epoch seconds), operation."""
        known = self.versions()
        version = known[-1] if version is None else version
        p, fs = fs_of(self.spark, self._manifest(version))
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, folders: list[str], schema: StructType, operation: str, names: dict | None = None) -> int:
        import time

        version = max(self.versions(), default=-1) + 1
        p, fs = fs_of(self.spark, self._manifest(version))
        out = fs.create(p, False)  # an error where another writer has made it
        try:
            out.write(bytearray(json.dumps({"folders": folders, "schema": schema.jsonValue(), "at": time.time(), "operation": operation, "names": names or {"renamed": {}, "dropped": []}}).encode()))
        finally:
            out.close()
        return version

    def _write(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def history(self) -> DataFrame:
        """(version, at, operation, folders) of each version."""
        rows = [(v, e["at"], e["operation"], len(e["folders"])) for v in self.versions() for e in [self.entry(v)]]
        return self.spark.createDataFrame(rows, "version int, at double, operation string, folders int").withColumn("at", F.timestamp_seconds("at"))

    def read(self, version: int | None = None, as_of: str | None = None) -> DataFrame:
        """The rows of a version, of the newest one at a time, or of the newest; columns that a folder lacks are NULL."""
        if as_of is not None:
            limit = self.spark.range(1).select(F.lit(as_of).cast("timestamp").cast("double")).first()[0]
            at = [v for v in self.versions() if self.entry(v)["at"] <= limit]
            if not at:
                raise ValueError(f"no version at {as_of}")
            version = at[-1]
        e = self.entry(version)
        schema = StructType.fromJson(e["schema"])
        if not e["folders"]:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in e["folders"]])
        old = {v: k for k, v in e["names"]["renamed"].items()}
        have = set(df.columns)

        def column(f) -> Column:
            source = [n for n in (f.name, old.get(f.name)) if n in have]
            return (F.coalesce(*[F.col(f"`{n}`").cast(f.dataType) for n in source]) if source else F.lit(None).cast(f.dataType)).alias(f.name)

        return df.select(*[column(f) for f in schema])

    def commit(self, df: DataFrame, operation: str = "overwrite") -> int:
        """A version of these rows and columns alone."""
        return self._commit([self._write(df)], df.schema, operation)

    def append(self, df: DataFrame) -> int:
        """New columns join the schema; missing ones are NULL. Only the new rows are written.

        A column with a name that was dropped or renamed away would meet the old values of that name: it is an error.
        """
        if not self.versions():
            return self.commit(df, "append")
        e = self.entry()
        schema = StructType.fromJson(e["schema"])
        names = {f.name for f in schema}
        before = {*e["names"]["dropped"], *e["names"]["renamed"]}
        if again := [f.name for f in df.schema if f.name in before and f.name not in names]:
            raise ValueError(f"dropped or renamed before: {sorted(again)}; compact first")
        for f in df.schema:
            if f.name not in names:
                schema = schema.add(f)
        return self._commit([*e["folders"], self._write(df)], schema, "append", e["names"])

    def alter(self, add: dict[str, str] | None = None, drop: Sequence[str] = (), rename: dict[str, str] | None = None) -> int:
        """Columns added, dropped or renamed by the manifest alone; no row is written. A dropped name that is added again would show old values: it is an error."""
        e = self.entry()
        renamed, gone = dict(e["names"]["renamed"]), set(e["names"]["dropped"])
        if again := (set(add or {}) | set((rename or {}).values())) & gone:
            raise ValueError(f"dropped before: {sorted(again)}; compact first")
        out = StructType()
        for f in StructType.fromJson(e["schema"]):
            if f.name in drop:
                gone.add(f.name)
            elif rename and f.name in rename:
                renamed = {k: v for k, v in renamed.items() if v != f.name} | {next((k for k, v in renamed.items() if v == f.name), f.name): rename[f.name]}
                out = out.add(rename[f.name], f.dataType)
            else:
                out = out.add(f)
        for name, kind in (add or {}).items():
            out = out.add(StructType.fromDDL(f"`{name}` {kind}")[0])
        return self._commit(e["folders"], out, "alter", {"renamed": renamed, "dropped": sorted(gone)})

    def restore(self, version: int) -> int:
        """The newest version is a copy of an older one's manifest."""
        e = self.entry(version)
        return self._commit(e["folders"], StructType.fromJson(e["schema"]), f"restore {version}", e["names"])

    def compact(self, *columns: str, z: bool = False) -> int:
        """One folder of the newest version's rows, laid out by columns where given."""
        df = self.read()
        return self.commit((z_order if z else clustered)(df, *columns) if columns else df.hint("rebalance"), "compact")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forget all but the newest `keep` versions and delete the folders that only those used."""
        known = self.versions()
        old, new = known[: max(len(known) - max(keep, 1), 0)], known[max(len(known) - max(keep, 1), 0) :]
        used = {f for v in new for f in self.entry(v)["folders"]}
        gone = sorted({f for v in old for f in self.entry(v)["folders"]} - used)
        for name in [*gone, *[self._manifest(v)[len(self.path) + 1 :] for v in old]]:
            p, fs = fs_of(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)
        return gone

    def changes(self, keys: list[str], since: int, until: int | None = None) -> DataFrame | None:
        """The change feed of all versions after `since`, with each version's time; None where there is none."""
        from heddle.operators.merge import change_feed

        out = None
        vs = [v for v in self.versions() if v >= since and (until is None or v <= until)]
        for a, b in zip(vs, vs[1:]):
            step = change_feed(self.read(a), self.read(b), keys, b).withColumn("_commit_timestamp", F.timestamp_seconds(F.lit(self.entry(b)["at"])))
            out = step if out is None else out.unionByName(step, allowMissingColumns=True)
        return out

    def consume(self, keys: list[str], state: str, handle) -> dict[str, int]:
        """Hand the changes since the last call to `handle` and remember the version in the file `state`; counts by type of change."""
        p, fs = fs_of(self.spark, state)
        since = 0
        if fs.exists(p):
            stream = fs.open(p)
            since = int(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        newest = self.versions()[-1]
        rows = self.changes(keys, since, newest)
        counts: dict[str, int] = {}
        if rows is not None:
            handle(rows)
            counts = {r[0]: r[1] for r in rows.groupBy("_change_type").count().collect()}
        out = fs.create(p, True)
        out.write(bytearray(str(newest).encode()))
        out.close()
        return counts
