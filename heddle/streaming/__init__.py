"""Structured Streaming: file and rate sources, projections, stateful counts and incremental change handling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """A stream of a folder's files, its schema taken from those there."""
    schema = spark.read.format(fmt).option("header", True).load(folder).schema
    return spark.readStream.schema(schema).format(fmt).option("header", True).load(folder)


def rate_stream(spark: SparkSession, per_second: int = 10, columns: dict[str, Column] | None = None) -> DataFrame:
    """(timestamp, value) at a rate, with derived columns."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().withColumns(columns or {})


def projected(stream: DataFrame, columns: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Columns and a filter without state."""
    out = stream.select(*[c.alias(n) for n, c in columns.items()])
    return out if where is None else out.where(where)


def windowed_counts(stream: DataFrame, at: str, every: str, late: str, by: str) -> DataFrame:
    """Counts by time window and key; rows later than `late` are dropped with their windows' state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every), by).agg(F.count(F.lit(1)).alias("n"))


def first_seen(stream: DataFrame, at: str, late: str, keys: Sequence[str]) -> DataFrame:
    """The first row of each key, as far back as `late`."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def table_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of a parquet table, file or folder, as it is and as files are added."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(f"{path}*")


def arrived(stream: DataFrame, name: str = "stream") -> DataFrame:
    """The rows that a stream gives for what is there now: run to its end into a folder that all executors share, and read from it."""
    from heddle.sources.tables import shared_path

    path = shared_path(stream.sparkSession, name)
    run_available(stream, f"{path}/rows", f"{path}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def check_checkpoint(path: str, shared: Sequence[str] = ("hdfs://", "s3a://", "abfss://", "gs://", "viewfs://", "dbfs:/", "/"), refused: Sequence[str] = ("/tmp", "file:///tmp")) -> str:
    """The path itself; ValueError unless it is on storage that all executors share and that outlives them."""
    p = path.strip()
    if not p or p.startswith(tuple(refused)) or not p.startswith(tuple(shared)):
        raise ValueError(f"a checkpoint must be on shared, lasting storage, not {path!r}")
    return p


def run_available(df: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Take what is there and stop: to a folder, or to a function per batch."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (w.foreachBatch(sink) if callable(sink) else w.format("parquet").option("path", sink)).start().awaitTermination()


def append_to(df: DataFrame, target: str, checkpoint: str, every: str | None = "10 seconds", name: str | None = None, table: bool = False):
    """Start an append query to a folder or a table of the catalog, every so often or (None) with what is there, and return it."""
    w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    w = w.queryName(name) if name else w
    return w.toTable(target) if table else w.format("parquet").option("path", target).start()


def merge_batches(path: str, keys: Sequence[str], order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function per batch that upserts each into a table by its keys: of a key's rows in one batch that of the greatest `order` wins, ties and no order by all columns."""
    from heddle.sources.tables import write_mode

    def handle(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*([order] if order else []), *rest)).alias("r")).select(*keys, "r.*")
        write_mode(one, path, "MERGE", keys)

    return handle
