"""Change feeds of streams: upserts and deletes by key become inserts, deletes, and updates with what was there before."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Changes(StatefulProcessor):
    """Keeps of each key the version it is at and its values; a version's last row of a key counts."""

    def __init__(self, keys: Sequence[str], values: StructType):
        self.keys, self.values = list(keys), values
        self.names = [f.name for f in values]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = [StructField("_version", LongType()), StructField("_there", BooleanType()), *self.values.fields]
        self.state = handle.getValueState("row", StructType(kinds))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last: dict = {}  # a row a version
        for row in rows:
            values = [row[c] for c in self.names]
            rank = (row["_order"] is not None, row["_order"] or 0, not row["_gone"], repr(values))
            if row["_version"] not in last or rank > last[row["_version"]][0]:
                last[row["_version"]] = (rank, row["_gone"], values)
        held = self.state.get() if self.state.exists() else None
        at, before, moved = None, None, False
        if held is not None:
            at, before = held[0], list(held[2:]) if held[1] else None
        for version in sorted(last):
            if at is not None and version <= at:
                continue  # told before, or overtaken
            _, gone, values = last[version]
            after, at, moved = None if gone else values, version, True
            if before is None and after is not None:
                yield self.told(key, after, "insert", version)
            elif before is not None and after is None:
                yield self.told(key, before, "delete", version)
            elif before is not None and repr(before) != repr(after):
                yield self.told(key, before, "update_preimage", version)
                yield self.told(key, after, "update_postimage", version)
            before = after
        if moved:
            self.state.update((at, before is not None, *(before if before is not None else [None] * len(self.names))))

    def told(self, key, values: list, kind: str, version: int) -> Row:
        return Row(*self.keys, *self.names, "_change_type", "_commit_version")(*key, *values, kind, version)

    def close(self) -> None:
        pass


def change_stream(upserts: DataFrame, keys: Sequence[str], version: str, order: str | None = None, deleted: str | None = None) -> DataFrame:
    """insert, delete, update_preimage and update_postimage rows of a stream of upserts, as `change_feed` gives them for whole tables.

    A row holds what its key is from `version` (a whole number) on; where `deleted` is true the key is gone. Of a key's rows of one version
    that of the greatest `order` counts, of equal ones a row that stays before one that goes, then the greater values. What comes again, or
    comes later than a newer version of its key, changes nothing: so a replay neither loses nor doubles changes. A key's rows
    of one version must come in one micro-batch. Keys that are NULL are keys. The state is a row a key, in RocksDB, which this sets as the
    session's state store.
    """
    spark = upserts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    aside = {version, order, deleted}
    values = StructType([StructField(f.name, f.dataType, True) for f in upserts.schema if f.name not in keys and f.name not in aside])
    made = upserts.select(*keys, *[f.name for f in values], F.col(version).cast("long").alias("_version"), (F.col(order) if order else F.lit(0)).cast("long").alias("_order"), (F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)).alias("_gone"))
    out = StructType([*[StructField(k, upserts.schema[k].dataType) for k in keys], *values.fields, StructField("_change_type", StringType()), StructField("_commit_version", LongType())])
    grouped = made.where("_version is not null").groupBy(*keys)
    return grouped.transformWithState(Changes(keys, values), outputStructType=out, outputMode="append", timeMode="none")


def handled_once(path: str, handle: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function per batch that writes what `handle` makes of it, a folder a batch: a batch that is run again after a failure takes the place of itself."""

    def batch(rows: DataFrame, number: int) -> None:
        handle(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return batch
