"""Queries of the workload beyond the first: scores and labels, joins by several keys and hints, frames, keys, texts, cubes, learners."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.functions import scores, text
from heddle.operators import merge, models
from heddle.sources import align_to_target, generator, readers, tables

from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col


@query("src_range_derived", "SELECT i AS id, i % 7 AS k, i * 0.5 AS v, date_add(DATE '2024-01-01', CAST(i AS INTEGER))::DATE::VARCHAR AS day FROM range(1000) r(i)")
def _(t):
    return readers.generated(t.spark, 1000, {"k": c("id") % 7, "v": c("id") * 0.5, "day": F.date_add(F.lit("2024-01-01").cast("date"), c("id").cast("int")).cast("string")})


@query("src_inline_rows", "SELECT n_nationkey, label FROM nation JOIN (VALUES (0, 'west'), (1, 'east')) v(k, label) ON n_regionkey = k")
def _(t):
    v = t.spark.sql("SELECT * FROM VALUES (0, 'west'), (1, 'east') AS v(k, label)")
    return t.nation.join(F.broadcast(v), c("n_regionkey") == c("k")).select("n_nationkey", "label")


@query("src_json_rows", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    packed = t.customer.select(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("json_string"))
    return packed.select(F.from_json("json_string", "c_custkey bigint, c_name string, c_acctbal double").alias("r")).select("r.*")


@query("src_cube_cells", "SELECT r_name AS row_0, k AS column_0, CAST(sum(CASE WHEN n_nationkey % 5 = k THEN n_nationkey ELSE 0 END) AS VARCHAR) AS value FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN range(5) r(k) GROUP BY 1, 2")
def _(t):
    sums = F.array(*[F.sum(F.when(c("n_nationkey") % 5 == k, c("n_nationkey")).otherwise(0)).cast("string") for k in range(5)])
    n = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(sums.alias("v"))
    grid = n.agg(F.array_sort(F.collect_list(F.struct("r_name", "v"))).alias("x"))
    answer = grid.select(F.flatten(F.transform("x", lambda x: x["v"])).alias("cells"), F.transform("x", lambda x: F.array(x["r_name"])).alias("row_tuples"), F.array(*[F.array(F.lit(str(k))) for k in range(5)]).alias("column_tuples"))
    return readers.cells_to_rows(answer).select(c("row_members")[0].alias("row_0"), c("column_members")[0].cast("bigint").alias("column_0"), "value")


@query("src_planning_slice", "SELECT o_orderpriority AS row_0, s AS column_0, 'Actual' AS pov_0, CAST(count(o_orderkey) AS VARCHAR) AS value FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) CROSS JOIN (VALUES ('F'), ('O'), ('P')) v(s) LEFT JOIN orders ON o_orderpriority = p AND o_orderstatus = s GROUP BY o_orderpriority, s")
def _(t):
    per = t.orders.groupBy("o_orderpriority").agg(*[F.count_if(c("o_orderstatus") == s).cast("string").alias(s) for s in "FOP"])
    rows = per.agg(F.collect_list(F.struct(F.array("o_orderpriority").alias("headers"), F.array("F", "O", "P").alias("data"))).alias("rows"))
    one = rows.select(F.array(F.lit("Actual")).alias("pov"), F.array(*[F.array(F.lit(s)) for s in "FOP"]).alias("columns"), "rows")
    return readers.slice_to_rows(one).select(c("row_members")[0].alias("row_0"), c("column_members")[0].alias("column_0"), c("pov")[0].alias("pov_0"), "value")


@query("src_generated", "SELECT 1000 AS orders, 1000 AS different, 0 AS orphans, TRUE AS in_range")
def _(t):
    made = generator.generate(t.spark, [{"name": "orders", "rows": 1000, "columns": [{"name": "id", "type": "integer", "unique": True, "range": [1, 5000]}, {"name": "buyer", "type": "reference", "ref_table": "people", "ref_column": "email"}, {"name": "kind", "type": "choice", "values": ["a", "b"], "weights": [3, 1]}]}, {"name": "people", "rows": 50, "columns": [{"name": "email", "type": "email", "unique": True}]}])
    n = made["orders"].agg(F.count(F.lit(1)).cast("int").alias("orders"), F.count_distinct("id").cast("int").alias("different"), F.bool_and(c("id").between(1, 5000)).alias("in_range"))
    lost = made["orders"].join(made["people"], c("buyer") == c("email"), "left_anti").agg(F.count(F.lit(1)).cast("int").alias("orphans"))
    return n.join(lost)


@query("src_files", "SELECT CAST(count(*) AS BIGINT) AS rows FROM orders")
def _(t):
    return readers.files_of(t.orders).agg(F.sum("rows").alias("rows"))


@query("snk_align", "SELECT CAST(o_orderkey AS INT) AS O_ORDERKEY, CAST(NULL AS VARCHAR) AS note, o_orderstatus FROM orders")
def _(t):
    return align_to_target(t.orders, t.spark.createDataFrame([], "O_ORDERKEY int, note string, o_orderstatus string").schema)


@query("snk_schema_merge", "SELECT c_custkey AS k, c_acctbal AS bal, CAST(NULL AS INT) AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def _(t):
    return t.customer.select(c("c_custkey").alias("k"), c("c_acctbal").alias("bal")).unionByName(t.part.select(c("p_partkey").alias("k"), c("p_size").alias("size")), allowMissingColumns=True)


@query("tbl_clustered", "SELECT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return tables.clustered(t.lineitem, "l_shipdate", "l_suppkey").select("l_orderkey", "l_linenumber")


@query("tbl_z_order", "SELECT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return tables.z_order(t.lineitem, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber")


@query("prj_additive_score", "SELECT c_custkey, round((CASE WHEN c_acctbal > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN c_nationkey < 10 THEN 0.2 ELSE 0 END) + (CASE WHEN length(c_mktsegment) > 8 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS score, round((1 - c_nationkey / 100.0) * 0.7 + 0.3, 6)::DOUBLE AS weighted FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.round(scores.additive_score([c("c_acctbal") > 0, c("c_nationkey") < 10, F.length("c_mktsegment") > 8]), 6).alias("score"), F.round(scores.risk_weighted(c("c_nationkey")), 6).alias("weighted"))


@query("prj_impute", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_quantity < 40 THEN l_quantity END, l_extendedprice * 0.25) AS q, coalesce(NULLIF(l_returnflag, 'R'), 'Unknown') AS flag FROM lineitem")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(c("l_quantity") < 40, c("l_quantity")).alias("q"), F.nullif("l_returnflag", F.lit("R")).alias("flag"), "l_extendedprice")
    return rows.withColumn("q", F.coalesce("q", c("l_extendedprice") * 0.25)).fillna("Unknown", ["flag"]).drop("l_extendedprice")


@query("prj_text_assembly", "SELECT p_partkey, 'Part ' || p_name || ' of ' || p_brand || ', size ' || CAST(p_size AS VARCHAR) || '.' AS line FROM part")
def _(t):
    return t.part.select("p_partkey", F.concat(F.lit("Part "), "p_name", F.lit(" of "), "p_brand", F.lit(", size "), c("p_size").cast("string"), F.lit(".")).alias("line"))


@query("fn_texts", "SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS first_upper, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded, (p_size % 10) / 10.0::DOUBLE AS share, CASE WHEN p_retailprice / 20 >= 90 THEN 'A' WHEN p_retailprice / 20 >= 80 THEN 'B' WHEN p_retailprice / 20 >= 70 THEN 'C' WHEN p_retailprice / 20 >= 60 THEN 'D' ELSE 'F' END AS grade, CASE WHEN contains(p_name, 'red') THEN 'warm' WHEN contains(p_name, 'blue') THEN 'cold' ELSE 'other' END AS tone, p_retailprice AS price FROM part")
def _(t):
    fraction = F.concat((c("p_size") % 10).cast("string"), F.lit("/10"))
    tone = scores.classify(c("p_name"), [("red", "warm"), ("blue", "cold")], "other")
    first = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.substring("p_name", 2, 1000)))
    return t.part.select("p_partkey", first.alias("first_upper"), F.lpad(c("p_size").cast("string"), 5, "0").alias("padded"), scores.share_of(fraction).alias("share"), scores.grade((c("p_retailprice") / 20).cast("string")).alias("grade"), tone.alias("tone"), scores.money(F.concat(F.lit("$"), c("p_retailprice").cast("string"))).alias("price"))


@query("fn_dates", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, dayofweek(o_orderdate) + 1 AS dow, dayofweek(o_orderdate) IN (0, 6) AS weekend, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Fall' END AS season FROM orders")
def _(t):
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), F.dayofweek(d).alias("dow"), scores.weekend(d).alias("weekend"), scores.season(d).alias("season"))


@query("fn_bytes", "SELECT doc_id, substr(text, 1, 2000) AS part FROM documents")
def _(t):
    return t.documents.select("doc_id", text.decode_text(F.encode("text", "UTF-8"), 2000).alias("part"))


@query("flt_composed", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000")
def _(t):
    return t.orders.where(text.both_filters("o_orderstatus = 'O'", text.both_filters(" ", "o_totalprice > 300000"))).select("o_orderkey")


@query("flt_template", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-14'")
def _(t):
    where = text.render("ts >= timestamp'{{ ds | date_add(-1) }}' and ts < timestamp'{{ ds }}'", {"ds": "2024-01-15"}).replace("T00:00:00", " 00:00:00")
    return t.events.where(where).select("event_id")


@query("flt_guarded", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 10")
def _(t):
    _, out = text.ask_tables(t.spark, "building customers", {"customer": t.customer}, lambda _: "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey", 10)
    return out


@query("flt_date_equal", "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'")
def _(t):
    day = F.lit("2024-01-10").cast("timestamp")
    return t.events.where((c("ts") >= day) & (c("ts") < F.date_add(day, 1))).select("event_id", "event_type")


@query("flt_null_safe_pairs", "SELECT a.user_id, count(*) AS n FROM (SELECT user_id, NULLIF(event_type, 'error') AS k FROM events) a WHERE a.k IS NOT DISTINCT FROM (CASE WHEN a.user_id % 2 = 0 THEN 'click' END) GROUP BY 1")
def _(t):
    rows = t.events.select("user_id", F.nullif("event_type", F.lit("error")).alias("k"))
    return rows.where(c("k").eqNullSafe(F.when(c("user_id") % 2 == 0, "click"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("jn_multi_key_left", "SELECT l.l_partkey, l.l_suppkey, l.n, o.big FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) l LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS big FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2) o ON o.l_partkey = l.l_partkey AND o.l_suppkey = l.l_suppkey")
def _(t):
    by = ["l_partkey", "l_suppkey"]
    n = t.lineitem.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.nullif(F.count_if(c("l_quantity") > 40), F.lit(0)).alias("_big"))
    big = t.lineitem.where("l_quantity > 40").groupBy(*by).agg(F.count(F.lit(1)).alias("big"))
    return n.drop("_big").join(big, by, "left")


@query("jn_null_safe_keys", "WITH a AS (SELECT event_id, NULLIF(event_type, 'view') AS k, CASE WHEN user_id % 3 = 0 THEN user_id % 5 END AS u FROM events), b AS (SELECT k, u, count(*) AS n FROM a GROUP BY 1, 2) SELECT a.event_id, b.n FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.u IS NOT DISTINCT FROM b.u")
def _(t):
    a = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("k"), F.when(c("user_id") % 3 == 0, c("user_id") % 5).alias("u"))
    b = a.groupBy(c("k").alias("k2"), c("u").alias("u2")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, c("k").eqNullSafe(c("k2")) & c("u").eqNullSafe(c("u2"))).select("event_id", "n")


@query("jn_hints", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1")
def _(t):
    """Dimensions of fixed size are broadcast, the two large tables meet by a shuffled hash join."""
    buyers = t.customer.join(F.broadcast(t.nation.where("n_regionkey = 1")), c("c_nationkey") == c("n_nationkey"))
    orders = t.orders.join(buyers, c("o_custkey") == c("c_custkey"), "left_semi")
    return t.lineitem.join(orders.hint("shuffle_hash"), c("l_orderkey") == c("o_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("jn_unseen", "SELECT u.user_id, k.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) k WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = k.event_type AND e.value > 40)")
def _(t):
    kinds = t.events.agg(F.collect_set("event_type").alias("k"))  # few by the table's design
    pairs = t.events.select("user_id").distinct().join(F.broadcast(kinds)).select("user_id", F.explode("k").alias("event_type"))
    return pairs.join(t.events.where("value > 40"), ["user_id", "event_type"], "left_anti")


@query("jn_anti_some", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000 AND o_orderstatus = 'F')")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000 and o_orderstatus = 'F'"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("ag_having_joined", "SELECT l_suppkey, round(avg(l_discount), 8) AS d FROM lineitem GROUP BY l_suppkey HAVING avg(l_discount) > (SELECT avg(l_discount) * 1.02 FROM lineitem)")
def _(t):
    a = scores.mean_of_decimals(c("l_discount"))
    bound = t.lineitem.agg((a * F.lit(Decimal("1.02"))).alias("bound"))
    return t.lineitem.groupBy("l_suppkey").agg(a.alias("a")).join(F.broadcast(bound)).where("a > bound").select("l_suppkey", F.round("a", 8).cast("double").alias("d"))


@query("ag_weighted_levels", "SELECT o_orderstatus, round(avg(CASE o_orderpriority WHEN '1-URGENT' THEN 3.0 WHEN '2-HIGH' THEN 2.0 WHEN '3-MEDIUM' THEN 1.0 ELSE 0 END), 6) AS level FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.round(F.avg(scores.weighted_level(c("o_orderpriority"), {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1})), 6).alias("level"))


@query("ag_labels", "SELECT l_suppkey, CASE WHEN avg(l_quantity) > 26 AND avg(l_discount) < 0.05 THEN 'strong' WHEN avg(l_quantity) > 25 THEN 'steady' ELSE 'weak' END AS label, (CASE WHEN avg(l_quantity) > 26 THEN 40 ELSE 0 END) + (CASE WHEN max(l_tax) > 0.07 THEN 30 ELSE 0 END) + (CASE WHEN count(*) > 600 THEN 30 ELSE 0 END) AS points, round(count(*) * 100.0 / (count(DISTINCT l_linenumber) * 720), 6)::DOUBLE AS used FROM lineitem GROUP BY 1")
def _(t):
    """The mean discount is told from 0.05 by the exact sum of the doubles, in any order of rows; quantities are whole, so that their sums are exact."""
    over = F.sum(scores.binary_units(c("l_discount"))) - F.count("l_discount") * scores.binary_units(F.lit(0.05))
    g = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), over.alias("d"), F.max("l_tax").alias("x"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("k"))
    return g.select("l_suppkey", scores.label([((c("q") > 26) & (c("d") < 0), "strong"), (c("q") > 25, "steady")], "weak").alias("label"), scores.points([(c("q") > 26, 40), (c("x") > 0.07, 30), (c("n") > 600, 30)]).alias("points"), F.round(scores.utilisation(c("n"), c("k")), 6).alias("used"))


@query("ag_error_median", "SELECT l_returnflag, round(quantile_disc(abs(l_extendedprice - l_quantity * 1500) / l_extendedprice * 100, 0.5), 6) AS median_error FROM lineitem GROUP BY 1")
def _(t):
    error = F.abs(c("l_extendedprice") - c("l_quantity") * 1500) / c("l_extendedprice") * 100
    return t.lineitem.withColumn("e", error).groupBy("l_returnflag").agg(F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY e)"), 6).alias("median_error"))


@query("ag_null_maps", "SELECT event_type, count(*) AS n, 0 AS with_map FROM events GROUP BY 1")
def _(t):
    rows = t.events.withColumn("extras", F.lit(None).cast("map<string,int>"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.map_keys("extras")).cast("int").alias("with_map"))


@query("ag_retention", "SELECT round(count(*) FILTER (l_quantity < 40) * 1.0 / count(*), 8) AS kept, count(*) FILTER (l_quantity < 40 AND l_discount > 0.05) AS good, count(*) FILTER (l_quantity < 40 AND NOT l_discount > 0.05) AS fair FROM lineitem")
def _(t):
    silver, good = c("l_quantity") < 40, c("l_discount") > 0.05
    return t.lineitem.agg(F.round(F.count_if(silver) / F.count(F.lit(1)), 8).alias("kept"), F.count_if(silver & good).alias("good"), F.count_if(silver & ~good).alias("fair"))


@query("ag_moments", "SELECT p_brand, round(var_samp(p_retailprice), 4) AS var, round(kurtosis_pop(p_retailprice), 6) AS kurt FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.round(F.variance("p_retailprice"), 4).alias("var"), F.round(F.kurtosis("p_retailprice"), 6).alias("kurt"))


@query("wn_global_rank", "SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS place FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def _(t):
    n = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(c("n").desc(), "p_brand")))


@query("wn_lag24", "SELECT event_id, round(value - lag(value, 24) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events")
def _(t):
    return t.events.select("event_id", F.round(c("value") - F.lag("value", 24).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 6).alias("change"))


@query("wn_before_only", "SELECT event_id, round(sum(value) OVER w, 2) AS before, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.round(F.sum("value").over(w), 2).alias("before"), F.count(F.lit(1)).over(w).alias("n"))


@query("wn_surrogate", "SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_name, c_custkey) AS id FROM customer")
def _(t):
    return tables.surrogate_keys(t.customer.select("c_custkey", "c_name"), ["c_name"], 1000).select("c_custkey", "id")


@query("set_one_scan", "SELECT user_id, 'large' AS label, event_id FROM events WHERE value > 30 UNION ALL SELECT user_id, 'error', event_id FROM events WHERE event_type = 'error'")
def _(t):
    """Two filters of one table as one scan: an array of what holds, exploded."""
    tags = F.filter(F.array(F.when(c("value") > 30, "large"), F.when(c("event_type") == "error", "error")), lambda x: x.isNotNull())
    return t.events.select("user_id", F.explode(tags).alias("label"), "event_id")


_BASE = "b AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer), i AS (SELECT c_custkey, c_nationkey, c_acctbal + 1 AS c_acctbal, CASE WHEN c_custkey % 6 = 0 THEN 'delete' ELSE 'update' END AS status FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 12 UNION ALL SELECT c_custkey + 1000000, c_nationkey, c_acctbal, 'insert' FROM customer WHERE c_custkey % 10 = 1 AND c_nationkey < 12)"


@query("merge_partitions_extra", f"WITH {_BASE} SELECT coalesce(b.c_custkey, i.c_custkey) AS c_custkey, coalesce(b.c_nationkey, i.c_nationkey) AS c_nationkey, CASE WHEN i.c_custkey IS NULL THEN b.c_acctbal ELSE i.c_acctbal END AS c_acctbal, CASE WHEN i.c_custkey IS NULL THEN b.c_mktsegment END AS c_mktsegment, i.status FROM (SELECT * FROM b WHERE c_nationkey IN (SELECT c_nationkey FROM i)) b FULL JOIN i ON b.c_custkey = i.c_custkey AND b.c_nationkey = i.c_nationkey WHERE coalesce(i.status, '') <> 'delete'")
def _(t):
    base = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    old = base.where("c_custkey % 3 = 0 and c_nationkey < 12").select("c_custkey", "c_nationkey", (c("c_acctbal") + 1).alias("c_acctbal"), F.when(c("c_custkey") % 6 == 0, "delete").otherwise("update").alias("status"))
    new = base.where("c_custkey % 10 = 1 and c_nationkey < 12").select((c("c_custkey") + 10**6).alias("c_custkey"), "c_nationkey", "c_acctbal", F.lit("insert").alias("status"))
    return merge.merge_partitions(base, old.union(new), ["c_custkey", "c_nationkey"], ["c_nationkey"], delete_when=c("status") == "delete")


@query("ml_labels", "SELECT o_custkey, CASE WHEN date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2002-01-01') > 400 THEN 1 ELSE 0 END AS churned, CASE WHEN max(o_totalprice) > 5 * avg(o_totalprice) OR count(*) > 25 THEN 1 ELSE 0 END AS suspect FROM orders GROUP BY 1")
def _(t):
    g = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.max("o_totalprice").alias("most"), F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.select("o_custkey", F.when(F.date_diff(F.lit("2002-01-01").cast("date"), "last") > 400, 1).otherwise(0).alias("churned"), F.when((c("most") > 5 * c("mean")) | (c("n") > 25), 1).otherwise(0).alias("suspect"))


@query("ml_group_means", "SELECT l_suppkey % 50 AS g, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy((c("l_suppkey") % 50).alias("g")).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("ml_recommend")
def _(t):
    """Parts that a customer has not ordered yet, by the quantities ordered."""
    lines = t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"))
    ratings = lines.groupBy(c("o_custkey").cast("int").alias("u"), c("l_partkey").cast("int").alias("i")).agg(F.avg("l_quantity").cast("float").alias("r"))
    return models.recommend(ratings, "u", "i", "r", 2)[0]


@query("llm_group_lines", "SELECT source, count(*) AS n, 'doc_id,lang' || chr(10) || string_agg(CAST(doc_id AS VARCHAR) || ',' || lang, chr(10) ORDER BY doc_id) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 50 GROUP BY 1")
def _(t):
    return text.group_lines(t.documents, ["source"], ["doc_id", "lang"], ["doc_id"], 50)


@query("llm_not_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return text.not_done(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("str_projection", "SELECT event_id, CASE WHEN value > 30 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS level, round(value * 1.1, 6) AS factored FROM events WHERE event_type <> 'view'")
def _(t):
    from heddle.streaming import arrived, projected, table_stream

    level = F.when(c("value") > 30, "high").when(c("value") > 10, "mid").otherwise("low")
    events = table_stream(t.spark, f"{t.sf_dir}/events.parquet").where("event_type <> 'view'")
    return arrived(projected(events, {"event_id": c("event_id"), "level": level, "factored": F.round(c("value") * 1.1, 6)}), "projection")


@query("str_kafka_text", "SELECT CAST(event_id AS VARCHAR) AS key, event_type AS value FROM events")
def _(t):
    from heddle.streaming import arrived, table_stream

    raw = table_stream(t.spark, f"{t.sf_dir}/events.parquet").select(c("event_id").cast("string").cast("binary").alias("key"), c("event_type").cast("binary").alias("value"))
    return arrived(readers.kafka_text(raw), "texts")
