"""Queries that apply the library's own operators: profiles, rules, drift, merges, history dimensions, change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import merge, quality

from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col


def _profile_sql(table: str, cols: dict[str, str]) -> str:
    parts = []
    for name, kind in cols.items():
        stats = {"count": "count(*)", "null_count": f"count(*) - count({name})", "null_pct": f"round((count(*) - count({name})) * 100.0 / count(*), 4)"}
        if kind == "n":
            stats |= {"min": f"min({name}) + 0", "max": f"max({name}) + 0", "mean": f"round(avg({name}), 6)", "stddev": f"round(stddev_samp({name}), 6)"}
        elif kind == "s":
            stats |= {"min_length": f"min(length({name}))", "max_length": f"max(length({name}))", "avg_length": f"round(avg(length({name})), 2)", "empty_count": f"count(*) FILTER ({name} = '')", "empty_pct": f"round(count(*) FILTER ({name} = '') * 100.0 / count(*), 4)"}
        else:
            stats |= {"min": f"floor(epoch(min({name})))", "max": f"floor(epoch(max({name})))"}
        parts += [f"SELECT '{name}' AS column_name, '{s}' AS stat, CAST({e} AS DOUBLE) AS value FROM {table}" for s, e in stats.items()]
    return " UNION ALL ".join(parts)


#: Left to queries of their own: estimates, and moments that SQL engines define differently.
_APPROXIMATE = ("approx_distinct", "quantiles", "variance", "skewness", "kurtosis")


def _exact(profiled):
    """Means and deviations to six decimals."""
    return profiled.withColumn("value", F.when(c("stat").isin("mean", "stddev"), F.round("value", 6)).otherwise(c("value")))


@query("profile_lineitem", _profile_sql("lineitem", {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"}))
def _(t):
    return _exact(quality.profile(t.lineitem, exclude=_APPROXIMATE))


@query("profile_customer", _profile_sql("customer", {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"}))
def _(t):
    return _exact(quality.profile(t.customer, exclude=_APPROXIMATE))


@query("metrics_by_segment", "SELECT '{\"event_type\":\"' || event_type || '\"}' AS dimension_value, metric_name, round(metric_value, 6) AS metric_value FROM (SELECT event_type, 'n' AS metric_name, CAST(count(*) AS DOUBLE) AS metric_value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'mean', avg(value) FROM events GROUP BY 1)")
def _(t):
    m = quality.long_metrics(t.events, {"n": F.count(F.lit(1)), "mean": F.avg("value")}, ["event_type"])
    return m.select(quality.segment_key(["event_type"]).alias("dimension_value"), "metric_name", F.round("metric_value", 6).alias("metric_value"))


def _rules():
    return {"quantity_positive": c("l_quantity") <= 0, "discount_range": ~c("l_discount").between(0, 0.08), "flag_set": ~c("l_returnflag").isin("A", "N"), "status_length": F.length("l_linestatus") > 1, "tax_present": c("l_tax").isNull()}


@query("rules_lineitem", "SELECT rule_name, violations, total FROM (SELECT count(*) AS total, count(*) FILTER (l_quantity <= 0) AS a, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.08) AS b, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS c, count(*) FILTER (length(l_linestatus) > 1) AS d, count(*) FILTER (l_tax IS NULL) AS e FROM lineitem), LATERAL (VALUES ('quantity_positive', a), ('discount_range', b), ('flag_set', c), ('status_length', d), ('tax_present', e)) v(rule_name, violations)")
def _(t):
    return quality.violations(t.lineitem, _rules())


@query("rules_score", "SELECT round(100 - (CASE WHEN count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.08) > 0 THEN 2.0 ELSE 0 END + CASE WHEN count(*) FILTER (l_returnflag NOT IN ('A', 'N')) > 0 THEN 1.0 ELSE 0 END) / 6.0 * 100, 2)::DOUBLE AS score FROM lineitem")
def _(t):
    return quality.score(quality.violations(t.lineitem, _rules()), {"discount_range": 2.0})


@query("rule_unique", "SELECT count(*) AS duplicates FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def _(t):
    return quality.unique_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("rule_foreign_key", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return quality.orphans(t.customer, "c_custkey", t.orders, "o_custkey").select("c_custkey")


@query("threshold_verdicts", "SELECT event_type, CASE WHEN avg(value) IS NULL THEN 1 WHEN avg(value) < 10 THEN 2 WHEN avg(value) > 50 THEN 1 ELSE 0 END AS severity FROM events GROUP BY event_type")
def _(t):
    m = t.events.groupBy("event_type").agg(F.avg("value").alias("v"))
    return m.select("event_type", quality.severity(c("v"), {"min": 10}, {"max": 50}).alias("severity"))


@query("history_latest", "SELECT metric_name, dimension_value, partition_ts, metric_value FROM (SELECT event_type AS metric_name, 'u' || (user_id % 3) AS dimension_value, CAST(event_id % 50 AS BIGINT) AS partition_ts, value AS metric_value, event_id % 11 = 0 AS gone, row_number() OVER (PARTITION BY event_type, user_id % 3, event_id % 50 ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND NOT gone")
def _(t):
    h = t.events.select(c("event_type").alias("metric_name"), F.concat(F.lit("u"), (c("user_id") % 3).cast("string")).alias("dimension_value"), (c("event_id") % 50).alias("partition_ts"), c("value").alias("metric_value"), c("event_id").alias("run_ts"), F.lit("collection").alias("record_type"), F.when(c("event_id") % 11 == 0, "false").alias("is_active"))
    return quality.latest_history(h).select("metric_name", "dimension_value", "partition_ts", "metric_value")


def _customers(t):
    old = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    new = old.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.when(c("c_custkey") % 8 == 0, c("c_acctbal") + 1).otherwise(c("c_acctbal")))
    more = new.union(old.where("c_custkey % 6 = 1").withColumn("c_custkey", c("c_custkey") + 10**6))
    return old, more


_NEW = "new AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 8 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey + 1000000, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 6 = 1), old AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer)"


@query("merge_into", f"WITH {_NEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_nationkey, n.c_nationkey) AS c_nationkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey")
def _(t):
    old, new = _customers(t)
    return merge.merge_into(old, new, ["c_custkey"], ["c_acctbal"])


@query("merge_partitions", f"WITH {_NEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_nationkey, n.c_nationkey) AS c_nationkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM (SELECT * FROM old WHERE c_nationkey IN (SELECT c_nationkey FROM new)) o FULL JOIN new n ON o.c_custkey = n.c_custkey AND o.c_nationkey = n.c_nationkey WHERE NOT coalesce(n.c_acctbal < -900, FALSE)")
def _(t):
    old, new = _customers(t)
    return merge.merge_partitions(old, new, ["c_custkey", "c_nationkey"], ["c_nationkey"], delete_when=c("c_acctbal") < -900)


@query("update_delete_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(t):
    return merge.update_where(merge.delete_where(t.customer, c("c_mktsegment") == "BUILDING"), c("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}).select("c_custkey", "c_acctbal")


@query("scd2", f"WITH {_NEW}, m AS (SELECT o.c_custkey AS k, o.c_acctbal AS ob, n.c_custkey AS nk, n.c_acctbal AS nb FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey) SELECT k AS c_custkey, ob AS c_acctbal, '2020-01-01' AS start_date, CASE WHEN nk IS NOT NULL AND nb IS DISTINCT FROM ob THEN '2024-06-01' END AS end_date, NOT coalesce(nk IS NOT NULL AND nb IS DISTINCT FROM ob, FALSE) AS is_current FROM m WHERE k IS NOT NULL UNION ALL SELECT nk, nb, '2024-06-01', NULL, TRUE FROM m WHERE nk IS NOT NULL AND (k IS NULL OR nb IS DISTINCT FROM ob)")
def _(t):
    old, new = _customers(t)
    dim = old.select("c_custkey", "c_acctbal", F.lit("2020-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"))
    out = merge.scd2(dim, new.select("c_custkey", "c_acctbal"), ["c_custkey"], ["c_acctbal"], "2024-06-01")
    return out.select("c_custkey", "c_acctbal", c("start_date").cast("string").alias("start_date"), c("end_date").cast("string").alias("end_date"), "is_current")


@query("change_feed", f"WITH {_NEW}, aft AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM (SELECT * FROM old WHERE c_custkey % 9 <> 5) o FULL JOIN new n ON o.c_custkey = n.c_custkey), m AS (SELECT o.c_custkey AS ok, o.c_acctbal AS ob, a.c_custkey AS ak, a.c_acctbal AS ab FROM old o FULL JOIN aft a ON o.c_custkey = a.c_custkey) SELECT ak AS c_custkey, ab AS c_acctbal, 'insert' AS _change_type, 2 AS _commit_version FROM m WHERE ok IS NULL UNION ALL SELECT ok, ob, 'delete', 2 FROM m WHERE ak IS NULL UNION ALL SELECT ok, ob, 'update_preimage', 2 FROM m WHERE ok = ak AND ob <> ab UNION ALL SELECT ok, ab, 'update_postimage', 2 FROM m WHERE ok = ak AND ob <> ab")
def _(t):
    old, new = _customers(t)
    after = merge.merge_into(old.where("c_custkey % 9 <> 5"), new, ["c_custkey"]).select("c_custkey", "c_acctbal")
    return merge.change_feed(old.select("c_custkey", "c_acctbal"), after, ["c_custkey"], 2)


@query("salted_join", "SELECT e.event_id, round(b.m, 6) AS m FROM events e JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) b USING (event_type)")
def _(t):
    b = t.events.groupBy("event_type").agg(F.avg("value").alias("m"))
    return merge.salted_join(t.events.select("event_id", "event_type"), b, "event_type").select("event_id", F.round("m", 6).alias("m"))


@query("mask_detected", "SELECT c_custkey, 'Xxxxxxxx#' || repeat('n', 9) AS c_name, c_mktsegment FROM customer")
def _(t):
    return merge.mask(t.customer.select("c_custkey", "c_name", "c_mktsegment"), {"customer": r"^Customer#\d+$"})
