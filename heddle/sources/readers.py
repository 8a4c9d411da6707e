"""Readers by kind: files, JDBC, Kafka, paged services, cubes, configured sources; what the catalog knows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import both_filters


def read_gz_csv(spark: SparkSession, glob: str, schema: str | None = None, parts: int | None = None) -> DataFrame:
    """Gzipped CSV files of a glob; a file is one task, since gzip cannot be split: with `parts` the rows are dealt anew, for few large files."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(glob)
    return df.repartition(parts) if parts else df


def read_json(spark: SparkSession, path: str, multiline: bool = False, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def read_binary(spark: SparkSession, path: str, extensions: Sequence[str] = (), recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content, extension) of files, by extension without case; content is read only where it is used."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    df = df.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return df.where(F.col("extension").isin([e.lower().lstrip(".") for e in extensions])) if extensions else df


def external_table(spark: SparkSession, name: str, path: str, columns: str, sep: str = "|", header: bool = True) -> DataFrame:
    """A catalog table over delimited files: CREATE TABLE ... USING csv."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING csv OPTIONS (path '{path}', sep '{sep}', header '{str(header).lower()}')")
    return spark.table(name)


#: Kinds of database: URL pattern, driver class, whether it may be written.
DATABASES = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", True),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", True),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", True),
    "hive": ("jdbc:hive2://{host}:{port}/{database}", "org.apache.hive.jdbc.HiveDriver", True),
    "azure_sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true", "com.microsoft.sqlserver.jdbc.SQLServerDriver", True),
    "derby": ("jdbc:derby:{database}", "org.apache.derby.iapi.jdbc.AutoloadedDriver", True),
    "snowflake": ("jdbc:snowflake://{host}:{port}/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", False),
}


def database(name: str, url: str, driver: str, writable: bool = False) -> None:
    """Make another kind of database known: a URL pattern with host, port and database, and its driver's class."""
    DATABASES[name] = (url, driver, writable)


def jdbc_options(kind: str, host: str, port: int, database: str, table: str | None = None, user: str | None = None, password: str | None = None, columns: Sequence[str] = (), where: str | None = None, sql: str | None = None, partition: dict | None = None, fetch_size: int = 10_000, row_limit: int | None = None, write: bool = False) -> dict[str, str]:
    """Options of a JDBC reader or writer; what is asked of columns and rows is pushed to the database as a query.

    `partition` is {column, num, lower, upper}: that many range reads, one a task. A kind that is read-only cannot be written.
    """
    if kind not in DATABASES:
        raise ValueError(f"unknown kind {kind!r}: {sorted(DATABASES)}")
    url, driver, writable = DATABASES[kind]
    if write and not writable:
        raise ValueError(f"{kind} is read-only")
    out = {"url": url.format(host=host, port=port, database=database), "driver": driver, "fetchsize": str(fetch_size)}
    out |= {k: v for k, v in (("user", user), ("password", password)) if v is not None}
    if sql or columns or where or row_limit:
        query = sql or f"SELECT {', '.join(columns) or '*'} FROM {table}" + (f" WHERE {where}" if where else "") + (f" LIMIT {row_limit}" if row_limit else "")
        out["dbtable"] = f"({query}) q"
    else:
        out["dbtable"] = table
    if partition:
        out |= {"partitionColumn": partition["column"], "numPartitions": str(partition["num"]), "lowerBound": str(partition["lower"]), "upperBound": str(partition["upper"])}
    return out


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    """A table or query of a database; needs its driver among the session's jars."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def kafka_options(servers: str, topic: str, user: str | None = None, password: str | None = None, starting: str = "latest", ending: str | None = None, most_per_trigger: int | None = None) -> dict[str, str]:
    """Options of Kafka readers, batch where `ending` is given; with a user, SASL/PLAIN over TLS."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if ending:
        out["endingOffsets"] = ending
    if most_per_trigger:
        out["maxOffsetsPerTrigger"] = str(most_per_trigger)
    if user:
        login = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{user}" password="{password}";'
        out |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login}
    return out


def kafka_text(df: DataFrame) -> DataFrame:
    """(key, value, topic, partition, offset, timestamp) of a Kafka frame, the bytes as texts; a stream or a batch."""
    rest = [c for c in ("topic", "partition", "offset", "timestamp") if c in df.columns]
    key = [F.col("key").cast("string").alias("key")] if "key" in df.columns else []
    return df.select(*key, F.col("value").cast("string").alias("value"), *rest)


#: Readers by name; a plug-in adds its own.
READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    def add(f):
        READERS[name] = f
        return f

    return add


for _format in ("parquet", "csv", "json", "orc", "text"):
    reader(_format)(lambda spark, path, _format=_format, **options: spark.read.format(_format).options(**options).load(path))
reader("jdbc")(read_jdbc)


@reader("rest")
def _(spark, **options):
    from .rest import read_rest

    return read_rest(spark, **options)


@reader("jdbc_even")
def _(spark, **options):
    from .jdbc import read_even

    return read_even(spark, **options)


@reader("kafka")
def _(spark, **options):
    return kafka_text(spark.read.format("kafka").options(**kafka_options(**options)).load())


reader("binary")(read_binary)


def read(spark: SparkSession, kind: str, /, **options) -> DataFrame:
    """A frame by the registered reader of that name."""
    if kind not in READERS:
        raise ValueError(f"no reader {kind!r}: {sorted(READERS)}")
    return READERS[kind](spark, **options)


def dicts_to_frame(spark: SparkSession, rows: Iterable[dict], schema: str | None = None, infer: bool = False, placeholder: str = "json_string string", at_once: int = 10_000) -> DataFrame:
    """Dicts of a service as JSON texts, with a schema as columns, or with types inferred; none at all give the schema, or the placeholder.

    The driver holds `at_once` rows at a time: each lot becomes a frame of its own in the JVM.
    """
    lots, held = [], []

    def flush() -> None:
        lots.append(spark.createDataFrame([(json.dumps(r, default=str),) for r in held], "json_string string"))
        held.clear()

    for r in rows:
        held.append(r)
        if len(held) == at_once:
            flush()
    if held:
        flush()
    if not lots:
        return spark.createDataFrame([], schema or placeholder)
    text = lots[0]
    for lot in lots[1:]:
        text = text.unionAll(lot)
    if infer and not schema:  # from all rows
        told = text.agg(F.schema_of_variant_agg(F.parse_json("json_string"))).first()[0]
        schema = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", told.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))
    return text.select(F.from_json("json_string", schema).alias("r")).select("r.*") if schema else text


def cells_to_rows(answers: DataFrame) -> DataFrame:
    """Long rows of a cube's answer: (row_members, column_members, value), cell k being row k div n and column k mod n.

    `answers` has cells array<string>, row_tuples and column_tuples array<array<string>>, one answer a row.
    """
    n = F.greatest(F.size("column_tuples"), F.lit(1))
    cells = answers.withColumn("_n", n).select("*", F.posexplode("cells").alias("_k", "value"))
    return cells.select(F.get("row_tuples", F.floor(F.col("_k") / F.col("_n")).cast("int")).alias("row_members"), F.get("column_tuples", F.pmod("_k", "_n")).alias("column_members"), "value")


def slice_to_rows(slices: DataFrame) -> DataFrame:
    """Long rows of planning slices: (pov, column_members, row_members, value).

    `slices` has pov array<string>, columns array<array<string>> and rows array<struct<headers:array<string>,data:array<string>>>.
    """
    rows = slices.select("pov", "columns", F.explode("rows").alias("r"))
    cells = rows.select("pov", "columns", F.col("r.headers").alias("row_members"), F.posexplode("r.data").alias("k", "value"))
    return cells.select("pov", F.get("columns", "k").alias("column_members"), "row_members", "value")


def generated(spark: SparkSession, n: int, columns: dict[str, Column], start: int = 0) -> DataFrame:
    """Rows of a range with derived columns, which may use id."""
    return spark.range(start, start + n).withColumns(columns)


def ingest(spark: SparkSession, source: dict) -> DataFrame:
    """Read a configured source, check its columns, prepare it with SQL over {source}, gate it and write it where a target is named.

    Keys: format or kind, path, options, columns (names expected), sql, filter, checks (rules of quality.gate), target, mode, partition_by.
    Whatever goes wrong is raised; nothing is swallowed.
    """
    from heddle.operators.quality import gate

    options = dict(source.get("options", {})) | ({"path": source["path"]} if "path" in source else {})
    df = read(spark, source.get("kind") or source["format"], **options)
    if expected := source.get("columns"):
        if set(expected) != set(df.columns):
            raise ValueError(f"{source.get('name')}: expected columns {sorted(expected)}, found {sorted(df.columns)}")
    if source.get("sql"):
        df = spark.sql(source["sql"], source=df)
    if where := both_filters(source.get("filter"), source.get("extra_filter")):
        df = df.where(where)
    if source.get("checks"):
        df = gate(df, source["checks"])
    if source.get("target"):
        df.write.mode(source.get("mode", "overwrite")).partitionBy(*source.get("partition_by", [])).parquet(source["target"])
        df = spark.read.parquet(source["target"])
    return df


def files_of(df: DataFrame) -> DataFrame:
    """(file_path, rows, bytes, modified) of the files that a frame reads."""
    m = F.col("_metadata")
    return df.select(m["file_path"].alias("file_path"), m["file_size"].alias("bytes"), m["file_modification_time"].alias("modified")).groupBy("file_path").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"), F.max("modified").alias("modified"))


def describe_catalog(spark: SparkSession, database: str | None = None) -> list[tuple[str, str, str]]:
    """(table, column, type) of all tables and views of a database."""
    out = []
    for t in spark.catalog.listTables(database):
        name = t.name if t.isTemporary else f"{t.namespace[-1]}.{t.name}" if t.namespace else t.name
        out += [(name, c.name, c.dataType) for c in spark.catalog.listColumns(name)]
    return sorted(out)


def location(spark: SparkSession, table: str) -> str | None:
    """Where a table's files are."""
    return next((r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect() if r.col_name == "Location"), None)
