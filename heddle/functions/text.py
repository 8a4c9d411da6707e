"""Texts of SQL: filters put together, templates with dates, what may run as a query; answers from a model about tables."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def both_filters(a: str | None, b: str | None) -> str | None:
    """Two SQL conditions as one, each in parentheses; blank ones count as none."""
    parts = [f"({x.strip()})" for x in (a, b) if x and x.strip()]
    return " AND ".join(parts) or None


def render(template: str, values: dict) -> str:
    """{{ name }}, {{ name | date_add(-1) }} and {{ name | date_format('%Y%m%d') }}, filters in a row; an unknown name or filter is an error."""

    def one(m: re.Match) -> str:
        name, *filters = [x.strip() for x in m[1].split("|")]
        if name not in values:
            raise KeyError(f"{name} is not defined")
        v = values[name]
        for f in filters:
            call = re.fullmatch(r"(\w+)\((.*)\)", f)
            if not call or call[1] not in ("date_add", "date_format"):
                raise ValueError(f"unknown filter {f!r}")
            day = v if isinstance(v, dt.date) else dt.datetime.fromisoformat(str(v))
            v = day + dt.timedelta(days=int(call[2])) if call[1] == "date_add" else day.strftime(call[2].strip("'\""))
        return v.isoformat() if isinstance(v, dt.date) else str(v)

    return re.sub(r"\{\{\s*(.*?)\s*\}\}", one, template)


#: Words that no query has, whole.
_BLOCKED = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|replace|set|call)\b", re.I)


def guard_select(sql: str, limit: int = 100) -> str:
    """The query with a limit where it has none; anything but one SELECT or WITH is an error. Quoted texts and names such as created_at are no commands."""
    text = sql.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    if not re.match(r"(select|with)\b", bare.strip(), re.I) or ";" in bare or _BLOCKED.search(bare):
        raise ValueError("only a single SELECT may run")
    return text if re.search(r"\blimit\s+\d+\s*$", bare, re.I) else f"{text}\nLIMIT {limit}"


def ask_tables(spark: SparkSession, question: str, tables: dict[str, DataFrame], ask: Callable[[str], str], limit: int = 100) -> tuple[str, DataFrame]:
    """(sql, rows): a model writes a query from the tables' columns, the guard lets it through, Spark runs it. `ask` is any function of a prompt."""
    told = "\n".join(f"{n}({', '.join(f'{c} {k}' for c, k in df.dtypes)})" for n, df in tables.items())
    sql = guard_select(ask(f"Tables:\n{told}\nWrite one SQL SELECT that answers: {question}"), limit)
    for n, df in tables.items():
        df.createOrReplaceTempView(n)
    return sql, spark.sql(sql)


def summarise(ask: Callable[[str], str], question: str, rows: DataFrame, most: int = 50) -> str:
    """A model's answer from at most `most` rows."""
    return ask(f"{question}\n" + "\n".join(str(r.asDict()) for r in rows.limit(most).collect()))


def group_lines(df: DataFrame, by: Sequence[str], columns: Sequence[str], order: Sequence[str], most: int = 500) -> DataFrame:
    """(by..., n, lines): the first `most` rows of each group as comma-separated lines under a header, for a prompt."""
    from pyspark.sql import Window

    cell = lambda c: F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), '[",\n]', " "), F.lit(""))
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most)
    rows = rows.select(*by, "_r", F.concat_ws(",", *[cell(c) for c in columns]).alias("_line"))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_r", "_line"))).alias("_l"))
    return out.select(*by, "n", F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")).alias("lines"))


def not_done(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no row in `done`: what a run before has answered is not asked again."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def model_column(ask: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function that asks a model for each distinct prompt of a batch; `ask` must be importable where workers run."""
    import pandas as pd

    @F.pandas_udf("string")
    def answers(prompts: pd.Series) -> pd.Series:
        known = {p: ask(p) for p in prompts.dropna().unique()}
        return prompts.map(known)

    return answers


def decode_text(content: Column, most: int = 200_000) -> Column:
    """Bytes as UTF-8 text, wrong bytes replaced, cut at so many characters as the reading side asks."""
    return F.substring(F.make_valid_utf8(content.cast("string")), 1, most)


def variant_columns(df: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with a column for each path, {name: (path, type)}; the JSON text is parsed once a row, into a VARIANT, whatever their number.

    A text that is no JSON, a path that is not there and a value that is not of the type give NULL.
    """
    held = df.withColumn("_variant", F.explode(F.array(F.try_parse_json(column))))
    return held.select(*df.columns, *[F.try_variant_get("_variant", path, kind).alias(name) for name, (path, kind) in paths.items()])
