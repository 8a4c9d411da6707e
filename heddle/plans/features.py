"""Queries of streams that run, sketches that roll up, attributions and samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from heddle.functions.text import variant_columns
from heddle.operators import attributions, layers, quality, rollup, sampling
from heddle.streaming import arrived, table_stream
from heddle.streaming.changes import change_stream

from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col

_CHANGES = """
WITH v AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS ver, event_type, value, event_type = 'error' AS gone FROM events QUALIFY row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY event_id DESC) = 1),
l AS (SELECT *, coalesce(lag(NOT gone) OVER w, FALSE) AS was, lag(event_type) OVER w AS t0, lag(value) OVER w AS v0 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ver))
SELECT user_id, event_type, value, 'insert' AS _change_type, ver AS _commit_version FROM l WHERE NOT gone AND NOT was
UNION ALL SELECT user_id, t0, v0, 'delete', ver FROM l WHERE gone AND was
UNION ALL SELECT user_id, t0, v0, 'update_preimage', ver FROM l WHERE NOT gone AND was AND (t0 IS DISTINCT FROM event_type OR v0 IS DISTINCT FROM value)
UNION ALL SELECT user_id, event_type, value, 'update_postimage', ver FROM l WHERE NOT gone AND was AND (t0 IS DISTINCT FROM event_type OR v0 IS DISTINCT FROM value)
"""


@query("str_change_feed", _CHANGES)
def _(t):
    events = table_stream(t.spark, f"{t.sf_dir}/events.parquet")
    day = F.floor(F.unix_seconds(c("ts").cast("timestamp")) / 86400)
    upserts = events.select("user_id", "event_type", "value", "event_id", day.alias("day"), (c("event_type") == "error").alias("gone"))
    return arrived(change_stream(upserts, ["user_id"], "day", "event_id", "gone"), "changes")


_COLUMNS = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


def _kept(t):
    """Sketches of lineitem by year of shipping, as they would be kept."""
    return rollup.sketch(t.lineitem.withColumn("year", F.year("l_shipdate")), _COLUMNS, ["year"])


def _facts(by: str, group: str) -> str:
    told = lambda x: f"SELECT {by}'{x}' AS column_name, count(*) AS rows, count(*) - count({x}) AS nulls, " + (f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 4) AS stddev" if x not in ("l_returnflag", "l_shipdate") else "NULL::DOUBLE AS mean, NULL::DOUBLE AS stddev") + f" FROM lineitem {group}"
    return " UNION ALL ".join(told(x) for x in _COLUMNS)


@query("rollup_exact", _facts("", ""))
def _(t):
    out = rollup.estimates(rollup.merge(_kept(t)))
    return out.select("column_name", "rows", "nulls", F.round("mean", 6).alias("mean"), F.when(c("mean").isNotNull(), F.round("stddev", 4)).alias("stddev"))


@query("rollup_span", _facts("", "WHERE year(l_shipdate) BETWEEN 1994 AND 1996"))
def _(t):
    out = rollup.estimates(rollup.merge(_kept(t).where("year between 1994 and 1996")))
    return out.select("column_name", "rows", "nulls", F.round("mean", 6).alias("mean"), F.when(c("mean").isNotNull(), F.round("stddev", 4)).alias("stddev"))


@query("rollup_distinct", " UNION ALL ".join(f"SELECT '{x}' AS column_name, count(DISTINCT {x}) AS exact, TRUE AS within FROM lineitem" for x in _COLUMNS))
def _(t):
    exact = t.lineitem.agg(*[F.count_distinct(x).alias(x) for x in _COLUMNS]).unpivot([], _COLUMNS, "column_name", "exact")
    near = rollup.estimates(rollup.merge(_kept(t))).select("column_name", "distinct_count")
    within = F.abs(c("distinct_count") - c("exact")) <= F.greatest(F.lit(1.0), rollup.DISTINCT_ERROR * c("exact"))
    return exact.join(near, "column_name").select("column_name", "exact", within.alias("within"))


_NUMBERS = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]


_ASKED = (0.01, 0.25, 0.5, 0.75, 0.99)


@query("rollup_quantiles", " UNION ALL ".join(f"SELECT '{x}' AS column_name, CAST({q} AS DOUBLE) AS quantile, CAST(quantile_disc({x}, {q}) AS DOUBLE) AS exact, TRUE AS within FROM lineitem" for x in _NUMBERS for q in _ASKED))
def _(t):
    """The exact quantiles, and whether each estimate's rank among all rows is near the rank asked for; equal values stand on a range of ranks."""
    near = rollup.estimates(rollup.merge(_kept(t)), _ASKED).where(c("column_name").isin(_NUMBERS)).select("column_name", F.posexplode("quantiles").alias("k", "estimate"))
    exact = quality.exact_quantiles(t.lineitem, _NUMBERS, _ASKED).withColumnRenamed("value", "exact")
    values = t.lineitem.select(*[c(x).cast("double").alias(x) for x in _NUMBERS]).unpivot([], _NUMBERS, "column_name", "x")
    held = values.join(F.broadcast(near), "column_name").groupBy("column_name", "k").agg(F.avg((c("x") < c("estimate")).cast("double")).alias("below"), F.avg((c("x") <= c("estimate")).cast("double")).alias("upto"))  # 20 rows are broadcast
    quantile = F.get(F.array(*[F.lit(q) for q in _ASKED]), c("k"))
    within = (c("below") - rollup.RANK_ERROR <= quantile) & (quantile <= c("upto") + rollup.RANK_ERROR)
    return held.select("column_name", quantile.alias("quantile"), within.alias("within")).join(exact, ["column_name", "quantile"]).select("column_name", "quantile", "exact", "within")


@query("rollup_top", "SELECT column_name, item, n FROM (SELECT 'l_returnflag' AS column_name, l_returnflag AS item, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_quantity', CAST(l_quantity AS VARCHAR), count(*) FROM lineitem GROUP BY 2)")
def _(t):
    near = rollup.estimates(rollup.merge(_kept(t)), top=100).where(c("column_name").isin("l_returnflag", "l_quantity"))
    return near.select("column_name", F.inline("top_values")).select("column_name", "item", c("count").alias("n"))


_SPLITS = """
WITH s AS (SELECT count(*) * 1.0 AS n, count(*) FILTER (l_quantity <= 25) AS a, count(*) FILTER (l_quantity > 25 AND l_discount <= 0.05) AS b FROM lineitem),
p AS (SELECT a / n AS p, b / (n - a) AS q FROM s),
f AS (SELECT l_returnflag, l_quantity <= 25 AS low, p * 1.0 + (1 - p) * (q * 4 + (1 - q) * 10) AS none, CASE WHEN l_quantity <= 25 THEN 1.0 ELSE q * 4 + (1 - q) * 10 END AS a, p * 1.0 + (1 - p) * CASE WHEN l_discount <= 0.05 THEN 4 ELSE 10 END AS b, CASE WHEN l_quantity <= 25 THEN 1.0 WHEN l_discount <= 0.05 THEN 4 ELSE 10 END AS ab FROM lineitem, p)
SELECT l_returnflag, feature, round(avg(abs(x)), 6) AS importance FROM (SELECT l_returnflag, 'quantity' AS feature, ((a - none) + (ab - b)) / 2 AS x FROM f UNION ALL SELECT l_returnflag, 'discount', ((b - none) + (ab - a)) / 2 FROM f) GROUP BY 1, 2
"""


@query("attributions_two_splits", _SPLITS)
def _(t):
    """A tree of two splits whose covers are counted from the table."""
    low, cheap = c("l_quantity") <= 25, c("l_discount") <= 0.05
    n, a, b = t.lineitem.agg(F.count(F.lit(1)), F.count_if(low), F.count_if(~low & cheap)).first()
    tree = attributions.Tree(np.array([0, -1, 1, -1, -1]), np.array([25.0, 0, 0.05, 0, 0]), np.array([1, 0, 3, 0, 0]), np.array([2, 0, 4, 0, 0]), np.array([n, a, n - a, b, n - a - b], float), np.array([0, 1.0, 0, 4.0, 10.0]))
    rows = attributions.attributions(t.lineitem.select("l_returnflag", F.array("l_quantity", "l_discount").alias("features")), attributions.explain([tree]))
    return attributions.mean_contributions(rows, ["quantity", "discount"], ["l_returnflag"]).select("l_returnflag", "feature", F.round("importance", 6).alias("importance"))


@query("json_variant", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2 AS half, json_extract_string(props, '$.k') AS text, NULL::INTEGER AS lost FROM events")
def _(t):
    """Props are parsed once a row, then read by path and type."""
    out = variant_columns(t.events, "props", {"k": ("$.k", "int"), "whole": ("$.k", "double"), "text": ("$.k", "string"), "lost": ("$.no.such[0]", "int")})
    return out.select("event_id", "k", (c("whole") / 2).alias("half"), "text", "lost")


@query("json_variant_sums", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS there FROM events GROUP BY event_type")
def _(t):
    out = variant_columns(t.events.select("event_type", "props"), "props", {"k": ("$.k", "bigint")})
    return out.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("there"))


_LAYERS = """
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS node, p_partkey // 3 AS needs FROM part WHERE p_partkey // 3 > 0 AND p_size > 10 UNION SELECT p_partkey, p_partkey - 7 FROM part WHERE p_partkey > 1900 AND p_size % 2 = 0),
n AS (SELECT node FROM e UNION SELECT needs FROM e),
w AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT node FROM e) UNION SELECT e.node, w.layer + 1 FROM w JOIN e ON e.needs = w.node)
SELECT node, CAST(max(layer) AS INTEGER) AS layer FROM w GROUP BY node
"""


@query("layers_of_parts", _LAYERS)
def _(t):
    """Each part needs the part of a third of its number, late ones another one too."""
    third = F.expr("p_partkey div 3")
    edges = t.part.where((third > 0) & (c("p_size") > 10)).select(c("p_partkey").alias("node"), third.alias("needs"))
    late = t.part.where((c("p_partkey") > 1900) & (c("p_size") % 2 == 0)).select("p_partkey", c("p_partkey") - 7)
    return layers.layers(edges.union(late))


@query("sample_blocks", "SELECT 'l_quantity' AS column_name, round(avg(l_quantity), 6) AS mean, round(sum(l_quantity), 2) AS total, TRUE AS mean_within, TRUE AS total_within FROM lineitem UNION ALL SELECT 'l_discount', round(avg(l_discount), 6), round(sum(l_discount), 2), TRUE, TRUE FROM lineitem")
def _(t):
    """What all rows give, and whether the intervals of a sample of blocks, at 99.99 %, hold it."""
    columns = ["l_quantity", "l_discount"]
    near = sampling.estimate(sampling.block_sample(t.lineitem, 0.4, block_rows=50), columns, 0.4, 0.9999).drop("mean", "total")
    exact = t.lineitem.agg(*[F.struct(F.avg(x).alias("m"), F.sum(x).alias("s")).alias(x) for x in columns]).unpivot([], columns, "column_name", "x")
    within = lambda x, name: c(x).between(c(f"{name}_low"), c(f"{name}_high")).alias(f"{name}_within")
    return exact.join(near, "column_name").select("column_name", F.round("x.m", 6).alias("mean"), F.round("x.s", 2).alias("total"), within("x.m", "mean"), within("x.s", "total"))
