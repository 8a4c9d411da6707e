"""Readers and writers."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .readers import dicts_to_frame as rows_to_frame
from .tables import VersionedTable, fs_of

__all__ = ["VersionedTable", "align_to_target", "fs_of", "paged", "read_delimited", "read_xlsx", "recover_overwrite", "rows_to_frame", "safe_overwrite", "xlsx_to_frame"]


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: StructType | str | None = None, infer: bool = False) -> DataFrame:
    """CSV with a header; a schema spares the pass that inference takes."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", infer)).csv(path)


def paged(fetch: Callable[[int, int], dict], limit: int = 500) -> Iterator[dict]:
    """Items of an offset/limit source until a page is empty or says it has no more."""
    offset = 0
    while True:
        page = fetch(offset, limit)
        items = page.get("items") or []
        yield from items
        if not items or not page.get("hasMore"):
            return
        offset += len(items)


def read_xlsx(path: str, sheet: str = "xl/worksheets/sheet1.xml") -> list[list[object]]:
    """Cells of one sheet, with nothing but the standard library: shared and inline strings, booleans, numbers."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        root = ElementTree.fromstring(z.read(sheet))
    out = []
    for row in root.iter(f"{ns}row"):
        cells: dict[int, object] = {}
        for c in row.iter(f"{ns}c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            kind, v = c.get("t"), c.find(f"{ns}v")
            if kind == "inlineStr":
                cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{ns}t"))
            elif v is not None:
                cells[at - 1] = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind == "str" else int(v.text) if re.fullmatch(r"-?\d+", v.text) else float(v.text)
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def xlsx_to_frame(spark: SparkSession, path: str, sheet: str = "xl/worksheets/sheet1.xml", header: bool = True) -> DataFrame:
    """A folder's or file's sheets as rows of texts, each workbook parsed where Spark reads it; the header comes from the first file."""
    files = spark.read.format("binaryFile").load(path)

    def parse(batches):
        import io

        import pyarrow as pa

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [["" if v is None else str(v) for v in r] for r in read_xlsx(io.BytesIO(raw.as_buffer().to_pybytes()), sheet)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["file", "row", "cells"])

    rows = files.select("path", "content").mapInArrow(parse, "file string, row int, cells array<string>")
    if not header:
        return rows
    first = rows.where("row = 0").orderBy("file").first()
    cell = lambda i, n: F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n)
    return rows.where("row > 0").select(*[cell(i, n) for i, n in enumerate(first.cells if first else [])])


def align_to_target(df: DataFrame, target: StructType) -> DataFrame:
    """The target's columns in order and type; missing ones are typed NULLs; names match without case."""
    names = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{names[f.name.lower()]}`") if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def safe_overwrite(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write beside, then swap: the old table may be read by df itself and stays if the write fails."""
    spark = df.sparkSession
    new, old = path.rstrip("/") + "._new", path.rstrip("/") + "._old"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(new)
    (p, fs), (n, _), (o, _) = fs_of(spark, path), fs_of(spark, new), fs_of(spark, old)
    had = fs.exists(p)
    if had:
        fs.delete(o, True)
        if not fs.rename(p, o):
            raise OSError(f"{path} could not be moved aside; the new rows are in {new}")
    if not fs.rename(n, p):
        if had:
            fs.rename(o, p)
        raise OSError(f"{new} could not take the place of {path}")
    fs.delete(o, True)


def recover_overwrite(spark: SparkSession, path: str) -> None:
    """Put a table back that an overwrite which died between its two renames left aside."""
    (p, fs), (o, _) = fs_of(spark, path), fs_of(spark, path.rstrip("/") + "._old")
    if fs.exists(o) and not fs.exists(p):
        fs.rename(o, p)
