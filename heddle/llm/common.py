"""Shared plumbing: the shared folder, staged tables, table reads and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that workers can import it; Arrow batches hold 1000 rows and about 8 MB at most."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:  # texts can be long: bounds a worker's batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    if getattr(sc, "_heddle_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "heddle_ship.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._heddle_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = getattr(spark.sparkContext, "_heddle_dir", None)
        if not base:
            base = spark.sparkContext._heddle_dir = "file://" + tempfile.mkdtemp(prefix="heddle-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/heddle/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run inside leave no shuffle files: Spark drops them as each query ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(*staged: DataFrame | None) -> None:
    """Delete tables that `stage` has written and that nothing reads any more."""
    for df in staged:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(value: Column) -> Column:
    """A column that is computed once a row: Spark moves no filter or projection across a generator, so none copies the expression."""
    return F.explode(F.array(value))


def _star_step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al., 2014) over edges (hi, lo), hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(low, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.union(low.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id on an edge; component is the smallest id reachable.

    Alternating large-star and small-star steps, each written to the shared folder; the edges never grow in number.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    e, before = stage(e, "edges"), None
    for _ in range(max_rounds):
        last, e = e, stage(_star_step(e), "edges")
        unstage(last)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(e.select("lo", "lo")).distinct()
