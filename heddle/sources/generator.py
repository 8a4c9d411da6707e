"""Synthetic tables from a description: every value follows from the row's number, the column and a seed, so that tasks need no state."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.lifecycle import layers


def _parent(col: dict) -> tuple[str, str] | None:
    """The (table, column) that a column refers to: by type reference, or by a name table.column."""
    if col["type"] == "reference":
        if not col.get("ref_table") or not col.get("ref_column"):
            raise ValueError(f"{col['name']}: a reference needs ref_table and ref_column")
        return col["ref_table"], col["ref_column"]
    return tuple(col["name"].split(".")) if "." in col["name"] else None


def _draw(name: str, seed: int) -> Column:
    """Uniform in 0 to 1."""
    return F.pmod(F.xxhash64("_i", F.lit(name), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def _shuffled(n: int, seed: int, span: int) -> Column:
    """A number below `span` that no other of n rows has: the row's number times a factor prime to the span, moved by the seed."""
    if span < n:
        raise ValueError(f"{n} different values are asked of {span}")
    from math import gcd

    factor = next(k for k in range(max(span * 5 // 8, 1) | 1, 4 * span + 9) if gcd(k, span) == 1)
    return F.pmod(F.col("_i").cast("decimal(38,0)") * F.lit(factor % max(span, 1)).cast("decimal(38,0)") + F.lit(seed), F.lit(span).cast("decimal(38,0)")).cast("bigint")


def _letters(number: Column, alphabet: str, length: int) -> Column:
    """`length` letters of an alphabet from a number, as its digits."""
    k = len(alphabet)
    digit = lambda j: F.substring(F.lit(alphabet), (F.floor(number / float(k**j)) % k + 1).cast("int"), F.lit(1)) if k**j < 1 << 53 else F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(number, F.lit(j)), F.lit(k)) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(j) for j in range(length)])


def _value(col: dict, n: int, seed: int) -> Column:
    name, kind, unique = col["name"], col["type"].lower(), col.get("unique", False)
    u = _draw(name, seed)
    if kind == "integer":
        a, z = col.get("range", [0, 100])
        return (F.lit(a) + (_shuffled(n, seed, z - a + 1) if unique else F.floor(u * (z - a + 1)))).cast("bigint")
    if kind == "float":
        (a, z), d = col.get("range", [0.0, 100.0]), col.get("decimals", 2)
        steps = int(round((z - a) * 10**d))
        return F.round(F.lit(float(a)) + (_shuffled(n, seed, steps + 1) / float(10**d) if unique else u * (z - a)), d)
    if kind in ("string", "email"):
        alphabet, length = col.get("chars", string.ascii_letters + string.digits if kind == "string" else string.ascii_lowercase), col.get("length", 10)
        span = min(len(alphabet) ** length, 1 << 53)
        text = _letters(_shuffled(n, seed, span) if unique else F.floor(u * span), alphabet, length)
        return F.concat(F.lit(col.get("prefix", "")), text, F.lit(col.get("suffix", "") if kind == "string" else "@" + col.get("domain", "example.com")))
    if kind == "choice":
        values, weights = col.get("values") or [], col.get("weights")
        if not values:
            raise ValueError(f"{name}: a choice needs values")
        weights, low, out = weights or [1] * len(values), 0.0, F
        for v, w in zip(values[:-1], weights):
            low += w / sum(weights)
            out = out.when(u < low, F.lit(v))
        return out.otherwise(F.lit(values[-1])) if len(values) > 1 else F.lit(values[0])
    if kind == "boolean":
        return u < float(col.get("true_probability", 0.5))
    if kind in ("date", "datetime"):
        a, z = (F.unix_seconds(F.lit(col.get(k, d)).cast("timestamp")) for k, d in (("start", "2020-01-01"), ("end", "2024-12-31")))
        at = F.timestamp_seconds(a + F.floor(u * (z - a + 1)))
        return at.cast("date") if kind == "date" else at
    if kind == "phone":
        return F.format_string("+1-%03d-%03d-%04d", (F.lit(200) + F.floor(u * 800)).cast("int"), (F.lit(200) + F.floor(_draw(name, seed + 1) * 800)).cast("int"), F.floor(_draw(name, seed + 2) * 10_000).cast("int"))
    if kind == "uuid":
        h = F.md5(F.concat_ws("/", F.lit(name), F.col("_i").cast("string"), F.lit(str(seed))))
        return F.concat_ws("-", *[F.substring(h, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    raise ValueError(f"{name}: unknown type {kind!r}")


def generate(spark: SparkSession, tables: Sequence[dict], seed: int = 42) -> dict[str, DataFrame]:
    """Frames by name of described tables: {name, rows, columns: [{name, type, ...}]}, parents before those that refer to them.

    Types: integer, float, string, choice (values, weights), boolean, date, datetime, email, phone, uuid, reference (ref_table,
    ref_column; also a name table.column). Unique numbers and texts are permutations of their span, with no second try. A reference
    draws a parent row's number and joins its value, so that parents of any size stay distributed.
    """
    by = {t["name"]: t for t in tables}
    needs = {t["name"]: {p[0] for c in t["columns"] if (p := _parent(c))} for t in tables}
    out: dict[str, DataFrame] = {}
    made: dict[str, DataFrame] = {}
    for name in (n for level in layers(needs) for n in level):
        if name not in by:
            raise ValueError(f"{name} is referred to but not described")
        t = by[name]
        df = spark.range(t["rows"]).withColumnRenamed("id", "_i")
        own = {c["name"]: _value(c, t["rows"], seed + k) for k, c in enumerate(t["columns"]) if not _parent(c)}
        df = df.withColumns(own) if own else df
        for k, c in enumerate(t["columns"]):
            if p := _parent(c):
                if not by[p[0]]["rows"]:
                    raise ValueError(f"{p[0]} has no rows to refer to")
                row = F.floor(_draw(c["name"], seed + k) * by[p[0]]["rows"]).cast("bigint")
                parent = made[p[0]].select(F.col("_i").alias("_p"), F.col(f"`{p[1]}`").alias("_v"))
                df = df.withColumn("_p", row).join(parent, "_p", "left").withColumn(c["name"], F.col("_v")).drop("_p", "_v")
        made[name] = df
        out[name] = df.select(*[F.col(f"`{c['name']}`") for c in t["columns"]])
    return out
