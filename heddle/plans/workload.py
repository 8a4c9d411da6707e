"""The analytical workload: filters, joins, aggregates, windows and sets over the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle import functions as fn
from heddle.functions import scores

from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col


@query("flt_point", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 42")
def _(t):
    return t.orders.where("o_custkey = 42").select("o_orderkey", "o_custkey", "o_totalprice")


@query("flt_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def _(t):
    return t.lineitem.where("l_shipdate >= timestamp'1996-01-01' and l_shipdate < timestamp'1996-02-01' and l_discount between 0.05 and 0.07 and l_quantity < 24").select("l_orderkey", "l_linenumber", "l_quantity")


@query("flt_like_in", "SELECT p_partkey, p_type, p_brand FROM part WHERE p_type LIKE 'ECO%' AND p_brand IN ('Brand#1', 'Brand#2')")
def _(t):
    return t.part.where(c("p_type").startswith("ECO") & c("p_brand").isin("Brand#1", "Brand#2")).select("p_partkey", "p_type", "p_brand")


@query("flt_regex", "SELECT c_custkey FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$') OR regexp_matches(c_name, '7$')")
def _(t):
    return t.customer.where(~c("c_name").rlike("^Customer#[0-9]{9}$") | c("c_name").rlike("7$")).select("c_custkey")


@query("flt_null_safe", "SELECT event_id FROM events WHERE NULLIF(event_type, 'error') IS NOT DISTINCT FROM NULL")
def _(t):
    return t.events.where(F.nullif("event_type", F.lit("error")).eqNullSafe(F.lit(None))).select("event_id")


@query("flt_named_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def _(t):
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least", args={"status": "P", "least": 200000}, orders=t.orders)


@query("prj_buckets", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'high' END AS band FROM orders")
def _(t):
    return t.orders.select("o_orderkey", fn.bucket(c("o_totalprice"), [(50000, "low"), (200000, "medium")], "high").alias("band"))


@query("prj_quality_score", "SELECT c_custkey, ((CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) + (CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0 ELSE 0.0 END))::DOUBLE / 2 AS score FROM customer")
def _(t):
    return t.customer.select("c_custkey", fn.quality_score([c("c_acctbal") > 0, c("c_mktsegment") == "HOUSEHOLD"]).alias("score"))


def dates_as_text(key, day):
    """Dates as text in each of parse_date's formats, by key."""
    formats = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy")
    text = F.when(key % 4 == 3, F.date_format(day, "yyyyMMdd"))
    for k, f in enumerate(formats):
        text = text.when(key % 4 == k, F.date_format(day, f))
    return text


@query("prj_parse_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(t):
    text = dates_as_text(c("o_orderkey"), c("o_orderdate"))
    return t.orders.select("o_orderkey", F.date_format(fn.parse_date(text), "yyyy-MM-dd").alias("day"))


@query("prj_clean_text", "SELECT p_partkey, CASE WHEN upper(trim(p_type)) IN ('ECONOMY', 'PROMO') THEN upper(trim(p_type)) ELSE 'UNKNOWN' END AS kind FROM part")
def _(t):
    return t.part.select("p_partkey", fn.clean_text(F.concat(F.lit(" "), F.lower("p_type")), ["ECONOMY", "PROMO"]).alias("kind"))


@query("prj_clip_default", "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 5), 40) AS clipped, CASE WHEN TRY_CAST(CAST(CAST(l_quantity AS INT) AS VARCHAR) AS INT) BETWEEN 0 AND 30 THEN CAST(l_quantity AS INT) ELSE 50 END AS q FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", fn.clip(c("l_quantity"), 5, 40).alias("clipped"), fn.int_or_default(c("l_quantity").cast("int").cast("string"), 0, 30, 50).alias("q"))


@query("prj_digits", "SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INT) AS brand_no FROM part")
def _(t):
    return t.part.select("p_partkey", fn.digits(c("p_brand")).alias("brand_no"))


@query("prj_ratio_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice / NULLIF(l_quantity, 0) AS unit_price FROM lineitem WHERE l_extendedprice / NULLIF(l_quantity, 0) BETWEEN 1000 AND 1500")
def _(t):
    unit = fn.ratio(c("l_extendedprice"), c("l_quantity"))
    return t.lineitem.where(unit.between(1000, 1500)).select("l_orderkey", "l_linenumber", unit.alias("unit_price"))


@query("jn_inner", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def _(t):
    return t.orders.where("o_totalprice > 300000").join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("jn_left_aggregate", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def _(t):
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(n, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("jn_star_top10", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10")
def _(t):
    star = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return star.groupBy("n_name").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue")).orderBy(c("revenue").desc(), "n_name").limit(10)


@query("jn_on_predicate", "SELECT c_custkey, count(o_orderkey) AS open_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus IN ('O', 'P') GROUP BY c_custkey")
def _(t):
    return t.customer.join(t.orders, (c("o_custkey") == c("c_custkey")) & c("o_orderstatus").isin("O", "P"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("open_orders"))


@query("jn_group_threshold", "SELECT e.event_id FROM events e JOIN (SELECT event_type, avg(value) + 2 * stddev_samp(value) AS bound FROM events GROUP BY event_type) b ON e.event_type = b.event_type WHERE e.value > b.bound")
def _(t):
    b = t.events.groupBy("event_type").agg((F.avg("value") + 2 * F.stddev("value")).alias("bound"))
    return t.events.join(b, "event_type").where("value > bound").select("event_id")


@query("jn_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return t.customer.join(t.orders, c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("jn_semi", "SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def _(t):
    return t.part.join(t.lineitem.where("l_quantity > 49"), c("l_partkey") == c("p_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("ag_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("ag_distinct_conditional", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (value > 50) AS large, round(avg(CASE WHEN value > 50 THEN value END), 6) AS avg_large, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 6) AS var FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(c("ts").cast("date")).alias("days"), F.count_if(c("value") > 50).alias("large"), F.round(F.avg(F.when(c("value") > 50, c("value"))), 6).alias("avg_large"), F.round(F.stddev("value"), 6).alias("sd"), F.round(F.variance("value"), 6).alias("var"))


@query("ag_quantiles", "SELECT l_returnflag, quantile_disc(l_quantity, 0.25) AS p25, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.75) AS p75 FROM lineitem GROUP BY l_returnflag")
def _(t):
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY l_quantity)")
    return t.lineitem.groupBy("l_returnflag").agg(q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"))


@query("ag_approx_distinct")
def _(t):
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("ag_two_level_share", "SELECT segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT o_custkey, CASE WHEN sum(o_totalprice) > 2000000 THEN 'gold' WHEN sum(o_totalprice) > 1000000 THEN 'silver' ELSE 'bronze' END AS segment FROM orders GROUP BY o_custkey) GROUP BY segment")
def _(t):
    total = F.sum("o_totalprice")
    per = t.orders.groupBy("o_custkey").agg(F.when(total > 2000000, "gold").when(total > 1000000, "silver").otherwise("bronze").alias("segment"))
    n = per.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("ag_monthly", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("ag_having", "SELECT l_suppkey, round(avg(l_discount), 8) AS d FROM lineitem GROUP BY l_suppkey HAVING avg(l_discount) > 0.05")
def _(t):
    """Means are exact in any order of rows; where one stands on half a unit, the SQL's running sums round it up or down by the order in which they add."""
    a = t.lineitem.groupBy("l_suppkey").agg(scores.mean_of_decimals(c("l_discount")).alias("a")).where("a > 0.05")
    return a.select("l_suppkey", F.round("a", 8).cast("double").alias("d"))


@query("ag_map_json", "SELECT o_custkey, string_agg(s || '=' || CAST(n AS VARCHAR), ',' ORDER BY s) AS by_status FROM (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def _(t):
    n = t.orders.groupBy("o_custkey", c("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("o_custkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("m"))
    return m.select("o_custkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_status"))


@query("ag_collect_set", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("ag_recency", "SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2002-01-01') AS recency, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS tenure FROM orders GROUP BY o_custkey")
def _(t):
    last, first = F.max("o_orderdate"), F.min("o_orderdate")
    return t.orders.groupBy("o_custkey").agg(F.date_diff(F.lit("2002-01-01").cast("date"), last).cast("long").alias("recency"), F.date_diff(last, first).cast("long").alias("tenure"))


@query("ag_ratio_of_sums", "SELECT l_shipmode_key, round(sum(l_extendedprice) / NULLIF(sum(l_quantity), 0), 6) AS of_sums, round(avg(l_extendedprice / NULLIF(l_quantity, 0)), 6) AS of_rows FROM (SELECT l_suppkey % 7 AS l_shipmode_key, * FROM lineitem) GROUP BY 1")
def _(t):
    return t.lineitem.groupBy((c("l_suppkey") % 7).alias("l_shipmode_key")).agg(F.round(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")), 6).alias("of_sums"), F.round(F.avg(fn.ratio(c("l_extendedprice"), c("l_quantity"))), 6).alias("of_rows"))


@query("ag_before_after", "SELECT event_type, round(avg(CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN value END) - avg(CASE WHEN ts < TIMESTAMP '2024-01-10' THEN value END), 6) AS change FROM events GROUP BY event_type")
def _(t):
    late = c("ts") >= F.lit("2024-01-10").cast("timestamp")
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.when(late, c("value"))) - F.avg(F.when(~late, c("value"))), 6).alias("change"))


@query("ag_flags", "SELECT user_id, avg(value) > 50 AS high, count(DISTINCT event_type) > 3 AS varied FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg((F.avg("value") > 50).alias("high"), (F.count_distinct("event_type") > 3).alias("varied"))


@query("ag_salted", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def _(t):
    part = t.events.groupBy("event_type", F.pmod(F.xxhash64("event_id"), F.lit(16)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return part.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("wn_keep_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.event_type")


@query("wn_top_category", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def _(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(c("n").desc(), "event_type"))).where("r = 1").select("user_id", "event_type")


@query("wn_rank_ties", "SELECT user_id, event_type FROM (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def _(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(c("n").desc()))).where("r = 1").select("user_id", "event_type")


@query("wn_month_trend", "WITH m AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS d, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY d) AS before FROM m) SELECT event_type, d, n, CASE WHEN before IS NULL THEN 'New' WHEN n > before * 1.1 THEN 'Improving' WHEN n < before * 0.9 THEN 'Declining' ELSE 'Stable' END AS trend FROM p")
def _(t):
    m = t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("d"))
    return m.withColumn("b", before).select("event_type", "d", "n", F.when(c("b").isNull(), "New").when(c("n") > c("b") * 1.1, "Improving").when(c("n") < c("b") * 0.9, "Declining").otherwise("Stable").alias("trend"))


@query("wn_gaps", "SELECT o_custkey, round(avg(gap), 6) AS avg_gap FROM (SELECT o_custkey, date_diff('day', CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), CAST(o_orderdate AS DATE)) AS gap FROM orders) GROUP BY o_custkey")
def _(t):
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_custkey", F.date_diff("o_orderdate", before).alias("gap")).groupBy("o_custkey").agg(F.round(F.avg("gap"), 6).alias("avg_gap"))


@query("wn_rolling", "SELECT event_id, round(avg(value) OVER w, 6) AS mean8, count(*) OVER w AS n8, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS before10 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(F.avg("value").over(w.rowsBetween(-7, 0)), 6).alias("mean8"), F.count(F.lit(1)).over(w.rowsBetween(-7, 0)).alias("n8"), F.round(F.avg("value").over(w.rowsBetween(-10, -1)), 6).alias("before10"))


@query("wn_percent_rank", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) * 100, 6) AS pct FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(F.percent_rank().over(Window.partitionBy("p_brand").orderBy("p_retailprice")) * 100, 6).alias("pct"))


@query("wn_impute", "SELECT event_id, round(coalesce(CASE WHEN value > 5 THEN value END, avg(CASE WHEN value > 5 THEN value END) OVER (PARTITION BY event_type)), 6) AS v FROM events")
def _(t):
    v = F.when(c("value") > 5, c("value"))
    return t.events.select("event_id", F.round(F.coalesce(v, F.avg(v).over(Window.partitionBy("event_type"))), 6).alias("v"))


@query("wn_epoch_bucket", "SELECT user_id, b, event_id FROM (SELECT user_id, event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS b, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    b = F.floor(F.unix_seconds(c("ts").cast("timestamp")) / 3600)
    return t.events.groupBy("user_id", b.alias("b")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("sl_top_values", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def _(t):
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "p_type").limit(10)


@query("sl_group_cap", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 3")
def _(t):
    return t.events.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("r <= 3").select("user_id", "event_id")


@query("sl_hash_sample")
def _(t):
    return t.events.orderBy(F.xxhash64("event_id", F.lit(42)), "event_id").limit(100)


@query("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("set_except_intersect", "(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT c_custkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders)")
def _(t):
    keys, bought = t.customer.select(c("c_custkey").alias("k")), t.orders.select(c("o_custkey").alias("k"))
    return keys.subtract(bought).union(t.customer.where("c_acctbal < 0").select(c("c_custkey").alias("k")).intersect(bought))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 90")
def _(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.where(k > 90).select("event_id", k.alias("k"))


@query("str_baseline_anomaly", "SELECT e.event_id, CASE WHEN e.value > b.m + 1.5 * b.s THEN 'HIGH' ELSE 'LOW' END AS flag FROM events e JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type) b USING (event_type) WHERE abs(e.value - b.m) > 1.5 * b.s")
def _(t):
    b = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev("value").alias("s"))
    return t.events.join(b, "event_type").where("abs(value - m) > 1.5 * s").select("event_id", F.when(c("value") > c("m") + 1.5 * c("s"), "HIGH").otherwise("LOW").alias("flag"))


@query("vec_cosine_topk", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def _(t):
    q = t.embeddings.where("vec_id = 7").select(c("embedding").alias("q"))
    return t.embeddings.crossJoin(F.broadcast(q.limit(1))).select("vec_id", F.round(fn.cosine(c("embedding"), c("q")), 6).alias("score")).orderBy(c("score").desc(), "vec_id").limit(10)


@query("vec_chunks", "SELECT doc_id, CAST(i AS INT) AS chunk, substr(text, CAST(1 + i * 1000 AS BIGINT), 1200) AS part FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.posexplode(fn.chunks(c("text"))).alias("chunk", "part"))


@query("vec_context_pack", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000")
def _(t):
    used = F.sum(F.length("text")).over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return t.documents.select("source", "doc_id", used.alias("used")).where("used <= 20000").select("source", "doc_id")
