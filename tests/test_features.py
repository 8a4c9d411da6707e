"""Change streams, attributions, sketches that roll up and JDBC reads of an embedded database."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from heddle import streaming
from heddle.functions import text
from heddle.operators import attributions, checks, history, layers, merge, models, quality, rollup, sampling
from heddle.sources import jdbc, readers, tables
from heddle.streaming.changes import change_stream, handled_once

VERSIONS = [
    [(1, "a", 1, False), (2, "b", 2**60, False), (None, "n", None, False), (3, None, 5, False)],
    [(1, "a", 1, False), (2, "x", 2**60 + 1, False), (4, "d", 4, False), (3, None, None, True)],
    [(1, None, None, False), (2, None, None, True), (3, "back", 3, False), (9, None, None, True), (None, "m", 0, False)],
    [(2, "again", 2, False), (4, "d", 4, False), (1, None, None, True)],
]
UPSERT = "k int, v string, n long, gone boolean, ver int"


def wanted(spark):
    """The change feed of whole tables, version by version."""
    out, table = None, {}
    frame = lambda t: spark.createDataFrame([(-1 if k is None else k, *v) for k, v in t.items()], "k int, v string, n long")  # noqa: E731  change_feed joins by equality
    for number, rows in enumerate(VERSIONS):
        gone = {k for k, _, _, deleted in rows if deleted}
        after = {k: v for k, v in table.items() if k not in gone} | {k: (v, n) for k, v, n, deleted in rows if not deleted}
        feed = merge.change_feed(frame(table), frame(after), ["k"], number)
        out, table = feed if out is None else out.union(feed), after
    return sorted(map(tuple, out.select("k", "v", "n", "_change_type", "_commit_version").collect()), key=str)


def put(spark, path, number):
    rows = [(*r, number) for r in VERSIONS[number]]
    spark.createDataFrame(rows, UPSERT).coalesce(1).write.mode("append").parquet(path)


def changes(spark, path):
    stream = streaming.table_stream(spark, path, files_a_batch=1)
    return change_stream(stream, ["k"], "ver", deleted="gone")


def read(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).withColumn("k", F.coalesce("k", F.lit(-1))).select("k", "v", "n", "_change_type", "_commit_version").collect()), key=str)


def test_change_stream_restarts(spark, tmp_path):
    source, sink, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for stop in ((0, 1), (2,), (), (3,)):  # a run with what is there, a new one from the checkpoint, one with nothing new
        for number in stop:
            put(spark, source, number)
        streaming.run_available(changes(spark, source), sink, state)
    assert read(spark, sink) == wanted(spark)
    put(spark, source, 3)  # the same version comes again
    streaming.run_available(changes(spark, source), sink, state)
    assert read(spark, sink) == wanted(spark)


def test_change_stream_in_one_batch_and_after_a_failure(spark, tmp_path):
    source, sink, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for number in range(4):
        put(spark, source, number)
    stream = streaming.table_stream(spark, source)
    feed = change_stream(stream, ["k"], "ver", deleted="gone")
    failed = []

    def handle(rows):
        if not failed:
            failed.append(1)
            rows.limit(1).write.mode("overwrite").parquet(f"{sink}/batch=0")  # half done
            raise RuntimeError("lost")
        return rows

    with pytest.raises(Exception, match="lost"):
        streaming.run_available(feed, handled_once(sink, handle), state)
    streaming.run_available(feed, handled_once(sink, handle), state)
    assert read(spark, sink) == wanted(spark)


def test_change_stream_order_and_late_rows(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    kind = "k int, t timestamp, x double, at long, ver int"
    day = "timestamp'2024-01-01 00:00:00.123456'"
    spark.sql(f"select * from values (1, {day}, double('nan'), 1, 1), (1, {day}, 2.5D, 2, 1), (1, {day}, 9D, null, 1)").toDF("k", "t", "x", "at", "ver").selectExpr("int(k)", "t", "x", "bigint(at)", "int(ver)").coalesce(1).write.parquet(source)
    run = lambda name: streaming.run_available(change_stream(streaming.table_stream(spark, source), ["k"], "ver", "at"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    run(0)
    first = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert [(r.x, r._change_type, r.t.microsecond) for r in first] == [(2.5, "insert", 123456)]
    spark.createDataFrame([(1, None, 7.0, 1, 0), (1, None, 8.0, 1, 2)], kind).coalesce(1).write.mode("append").parquet(source)
    run(1)
    got = sorted((r._commit_version, r._change_type, r.x) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [(1, "insert", 2.5), (2, "update_postimage", 8.0), (2, "update_preimage", 2.5)]  # version 0 came too late


def shapley(tree, x):
    """By all subsets of features; a split on a feature outside the subset takes both ways by cover."""

    def value(node, met):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        a, b = tree.left[node], tree.right[node]
        if f in met:
            goes = x[f] < tree.threshold[node] if tree.strict else x[f] <= tree.threshold[node]
            return value(a if goes else b, met)
        return (tree.cover[a] * value(a, met) + tree.cover[b] * value(b, met)) / tree.cover[node]

    d = len(x)
    out = np.zeros(d)
    for f in range(d):
        others = [k for k in range(d) if k != f]
        for size in range(d):
            for some in itertools.combinations(others, size):
                out[f] += math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d) * (value(0, {*some, f}) - value(0, set(some)))
    return out


def labelled(spark, n=400):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, 4)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n) > 0).astype(float)
    return x, spark.createDataFrame([(float(label), row.tolist()) for label, row in zip(y, x)], "label double, features array<double>")


def test_attributions_of_a_random_forest(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x, df = labelled(spark)
    data = df.withColumn("vector", array_to_vector("features"))
    model = RandomForestClassifier(featuresCol="vector", numTrees=6, maxDepth=4, seed=1).fit(data)
    trees = attributions.forest_trees(model, spark)
    explained = attributions.explain(trees)
    got = attributions.attributions(model.transform(data).select("features", vector_to_array("probability")[1].alias("p")), explained).collect()
    assert len(got) == 400
    for r in got[:25]:
        want = np.mean([shapley(t, np.array(r.features)) for t in trees], axis=0)
        assert np.allclose(r.contributions, want)
    assert all(abs(sum(r.contributions) + explained.base - r.p) < 1e-9 for r in got)  # they sum to the score
    mean = attributions.mean_contributions(spark.createDataFrame([(list(r.contributions),) for r in got], "contributions array<double>"), list("abcd")).collect()
    want = np.abs(np.array([r.contributions for r in got])).mean(0)
    assert {r.feature: round(r.importance, 9) for r in mean} == dict(zip("abcd", want.round(9)))


def test_attributions_of_an_isolation_forest(spark):
    x, df = labelled(spark)
    forest = models.isolation_forest(df, trees=5, sample=40)
    explained = attributions.explain(forest)
    got = explained.values(x[:20])
    for k in range(20):
        assert np.allclose(got[k], np.mean([shapley(t, x[k]) for t in forest], axis=0))
        assert abs(got[k].sum() + explained.base - np.mean([t.predict(x[k : k + 1]) for t in forest])) < 1e-9
    odd = spark.createDataFrame([(float(a), float(b), 0) for a, b in np.random.default_rng(0).normal(size=(300, 2))] + [(0.1, 40.0, 0)] * 3, "a double, b double, _period int")
    most = models.explain_shape(odd, ["a", "b"], anomalous=0.6, trees=30).orderBy("mean").first()
    assert most.feature == "b" and most.mean < 0


def test_pattern_check_names_what_tells_the_periods_apart(spark):
    rows = spark.range(600).selectExpr("rand(1) a", "rand(2) + if(id % 2 = 0, 0.6, 0) b", "'x' c", "int(id % 2) _period")
    got = models.pattern_check(rows, ["a", "b", "c"], trees=10, folds=2)
    names = [n for n, _ in got["contributions"]]
    assert names[0] == "b" and len(names) == 3 and got["contributions"][0][1] > 5 * got["contributions"][1][1]


def test_deep_trees_are_refused():
    n = 30
    chain = attributions.Tree(np.array([k // 2 if k % 2 == 0 and k < 2 * n else -1 for k in range(2 * n + 1)]), np.zeros(2 * n + 1), np.array([k + 1 if k % 2 == 0 and k < 2 * n else 0 for k in range(2 * n + 1)]), np.array([k + 2 if k % 2 == 0 and k < 2 * n else 0 for k in range(2 * n + 1)]), np.ones(2 * n + 1), np.ones(2 * n + 1))
    with pytest.raises(ValueError, match="too deep"):
        attributions.explain([chain], most_numbers=1000)


def test_sketches_are_kept_and_merged(spark, tmp_path):
    path = f"file://{tmp_path}/sketches"
    day = lambda d, lo, hi: spark.range(lo, hi).selectExpr(f"'{d}' day", "id k", "if(id % 10 = 0, null, id / 7D) x", "concat('v', id % 13) s", "id % 2 = 0 b")
    for d, lo, hi in (("mon", 0, 3000), ("tue", 2000, 9000), ("wed", 0, 10), ("tue", 2000, 5000)):  # tue is done again
        rollup.keep(day(d, lo, hi), ["k", "x", "s", "b"], ["day"], path)
    kept = spark.read.parquet(path)
    assert kept.count() == 12
    whole = day("mon", 0, 3000).union(day("tue", 2000, 5000)).union(day("wed", 0, 10))
    got = {r.column_name: r for r in rollup.estimates(rollup.merge(kept), top=20).collect()}
    exact = whole.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev("x").alias("s"), F.min("x").alias("a"), F.max("x").alias("b"), F.count_distinct("k").alias("d")).first()
    x = got["x"]
    assert (x.rows - x.nulls, x.rows) == (exact.n, 6010) and abs(x.mean - exact.m) < 1e-9 and abs(x.stddev - exact.s) < 1e-7
    assert (float(x.least), float(x.greatest)) == (exact.a, exact.b) and got["k"].greatest == "4999.0"
    assert abs(got["k"].distinct_count - exact.d) <= rollup.DISTINCT_ERROR * exact.d
    assert {r["item"]: r["count"] for r in got["s"].top_values} == {r.s: r["count"] for r in whole.groupBy("s").count().collect()}
    values = sorted(r.x for r in whole.where("x is not null").select("x").collect())
    for q, v in zip((0.25, 0.5, 0.75), x.quantiles):
        assert abs(np.searchsorted(values, v) / len(values) - q) <= rollup.RANK_ERROR + 1 / len(values)
    assert got["b"].quantiles is None and got["s"].mean is None and got["s"].least == "v0"
    days = {r.day: r.rows for r in rollup.merge(kept, ["day"]).where("column_name = 'k'").collect()}
    assert days == {"mon": 3000, "tue": 3000, "wed": 10}


def test_sketches_of_odd_columns(spark):
    odd = spark.createDataFrame([(float("nan"), None, None), (None, None, "")], "x double, y int, s string")
    got = {r.column_name: r for r in rollup.estimates(rollup.merge(rollup.sketch(odd, ["x", "y", "s"]))).collect()}
    assert (got["x"].rows, got["x"].nulls, got["x"].mean, got["x"].quantiles, got["x"].distinct_count) == (2, 2, None, None, 0)
    assert got["s"].nulls == 1 and got["s"].distinct_count == 1 and {(r["item"], r["count"]) for r in got["s"].top_values} == {("", 1), (None, 1)}
    empty = rollup.estimates(rollup.sketch(odd.limit(0), ["x", "s"])).collect()
    assert [r.rows for r in empty] == [0, 0] and rollup.sketch(odd.limit(0), ["x"], ["s"]).count() == 0


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    """Orders whose values crowd near zero, with far outliers, one value of many rows, and nulls."""
    where = f"{tmp_path_factory.mktemp('derby')}/shop"
    df = spark.range(6000).selectExpr("id", "case when id % 20 = 0 then null when id % 10 = 1 then 7.0 when id = 77 then -1e9 when id = 78 then 1e12 else exp(id / 700D) end v", "concat('n', id % 5) name")
    df.coalesce(1).write.format("jdbc").options(url=f"jdbc:derby:{where};create=true", driver=readers.DATABASES["derby"][1], dbtable="shop", createTableColumnTypes="name VARCHAR(20)").save()
    return where, df


def test_even_reads(spark, derby):
    where, df = derby
    even = jdbc.read_even(spark, "derby", "", 0, where, "shop", '"v"', 8)
    sizes = [r[0] for r in even.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").select("n").collect()]
    assert sum(sizes) == 6000 and sizes[-1] == 300  # those without a value
    share = 5700 / 8
    assert 7 <= len(sizes) - 1 <= 9 and max(sizes[:-1]) <= 2 * share and min(sizes[:-1]) >= share / 2
    assert sorted(map(tuple, even.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_filters_and_columns_reach_the_database(spark, derby):
    where, df = derby
    even = jdbc.read_even(spark, "derby", "", 0, where, "shop", '"v"', 4)
    asked = even.where("name = 'n3' and id > 100").select("id")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(NAME,n3)" in plan or "EqualTo(name,n3)" in plan
    assert "GreaterThan" in plan and "ReadSchema: struct<id:bigint>" in plan.replace("ID", "id")
    assert sorted(r[0] for r in asked.collect()) == sorted(r.id for r in df.where("name = 'n3' and id > 100").collect())
    some = jdbc.read_even(spark, "derby", "", 0, where, "shop", '"v"', 4, where='"id" < 1000')
    assert some.count() == 1000
    whole = readers.read(spark, "jdbc", kind="derby", host="", port=0, database=where, table="shop", sql="SELECT COUNT(*) AS n FROM shop WHERE \"name\" = 'n1'")
    assert whole.first()[0] == 1200


def test_cuts(spark, derby):
    where, _ = derby
    options = readers.jdbc_options("derby", "", 0, where, table="shop")
    assert jdbc.quantile_cuts(spark, options, "shop", '"v"', 1) == ([], 6000, 300)
    assert jdbc.quantile_cuts(spark, options, "shop", '"v"', 4, '"v" IS NULL')[0] == []
    assert jdbc.predicates("v", [], True) == ["1 = 1"]
    assert jdbc.predicates("v", [2.0, 1.5], True) == ["v < 1.5", "v >= 1.5 AND v < 2", "v >= 2", "v IS NULL"]


def test_kinds_are_added(spark):
    readers.database("testdb", "jdbc:test://{host}/{database}", "org.test.Driver")
    assert readers.jdbc_options("testdb", "h", 1, "d", table="t")["url"] == "jdbc:test://h/d"
    with pytest.raises(ValueError, match="read-only"):
        readers.jdbc_options("testdb", "h", 1, "d", table="t", write=True)
    assert {"rest", "jdbc", "jdbc_even", "kafka"} <= set(readers.READERS)


def test_block_samples(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(40_000).selectExpr("id", "id % 100 + if(id % 4000 < 400, 50, 0) v", "if(id % 3 = 0, null, 1.5D) w").repartition(80, "id").write.parquet(path)
    table = spark.read.parquet(path)
    files = table.select("_metadata.file_path").distinct().count()
    exact = {"v": table.agg(F.avg("v"), F.sum("v")).first(), "w": table.agg(F.avg("w"), F.sum("w")).first()}
    held = []
    for seed in range(40):
        sample = sampling.block_sample(table, 0.5, seed)
        if seed == 0:
            plan = sample._jdf.queryExecution().executedPlan().toString()
            read = sample.select("_metadata.file_path").distinct().count()
            assert "file_path" in plan and 0.3 * files < read < 0.7 * files
            again = sampling.block_sample(table, 0.5, seed)
            assert sorted(r.id for r in sample.collect()) == sorted(r.id for r in again.collect())
        for r in sampling.estimate(sample, ["v", "w"], 0.5, 0.95).collect():
            mean, total = exact[r.column_name]
            if r.column_name == "v":
                held.append(r.mean_low <= mean <= r.mean_high)
            else:
                assert abs(r.mean - mean) < 1e-9  # all alike: no error
            held.append(r.total_low <= total <= r.total_high)
    assert np.mean(held) >= 0.9  # of 95 %
    by_rows = sampling.block_sample(table, 0.5, 1, block_rows=20)
    assert by_rows.select("_block").distinct().count() > 500 and 0.4 < by_rows.count() / 40_000 < 0.6
    alone = sampling.estimate(table.limit(5).withColumn("_block", F.lit(1)), ["v"], 0.5).first()
    assert alone.mean_low is None and alone.blocks == 1
    with pytest.raises(ValueError):
        sampling.block_sample(table, 0)


def test_two_validators_read_one_sample(spark, tmp_path):
    source, store = f"file://{tmp_path}/t", sampling.SampleStore(spark, f"file://{tmp_path}/samples")
    spark.range(4000).selectExpr("id", "rand(1) + if(id % 2 = 0, 0.7, 0) v", "int(id % 2) _period").write.parquet(source)
    draw = lambda **o: store.sample("t", spark.read.parquet(source), ["id"], 0.5, where="id >= 100", **o)
    first = draw()
    ids = sorted(r.id for r in first.collect())
    assert 0.45 < len(ids) / 3900 < 0.55 and ids[0] >= 100
    spark.range(10).selectExpr("id", "0D v", "0 _period").write.mode("overwrite").parquet(source)  # the table moves on, the sample stays
    drift = models.explain_drift(draw(), ["v"]).where("stat = 'mean'").first()
    check = models.pattern_check(draw(), ["v"], trees=5, folds=2)
    assert drift.current > drift.past and check["auc"] > 0.7 and sorted(r.id for r in draw().collect()) == ids
    assert draw(seed=7).count() == 0 and len(list((tmp_path / "samples").iterdir())) == 2
    assert store.drop("t", ["id"], 0.5, where="id >= 100") and draw().count() == 0


def test_layers(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "b"), ("e", None), ("d", "b"), (None, "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "a")], "node string, needs string")
    assert {r.node: r.layer for r in layers.layers(edges).collect()} == {"a": 0, "e": 0, "b": 1, "v": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None, "w": None}
    assert sorted(r.node for r in layers.on_cycles(edges).collect()) == ["x", "y", "z"]
    assert layers.layers(edges.limit(0)).collect() == []
    with pytest.raises(ValueError, match="more than 2"):
        layers.layers(spark.range(1, 5).selectExpr("id node", "id - 1 needs"), most_layers=2)


def test_layers_write_once_a_round(spark, monkeypatch):
    written = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (written.append(a), write(self, *a, **k)))
    chain = spark.range(1, 10).selectExpr("id node", "id - 1 needs").union(spark.range(1).selectExpr("9L node", "0L needs"))
    assert {r.node: r.layer for r in layers.layers(chain).collect()} == {i: i for i in range(10)}
    assert len(written) <= 11


def test_variants(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "n": 5}'), (2, "no json"), (3, None), (4, "[1]"), (5, '{"n": "12", "a": 3}')], "id int, j string")
    out = text.variant_columns(df, "j", {"n": ("$.n", "int"), "x": ("$.a.b[1]", "string"), "a": ("$.a", "int")})
    assert sorted(map(tuple, out.select("id", "n", "x", "a").collect())) == [(1, 5, "x", None), (2, None, None, None), (3, None, None, None), (4, None, None, None), (5, 12, None, 3)]
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "generate explode" in plan and plan.count("parsejson") <= 1


def test_rules_that_share_a_name(spark):
    df = spark.createDataFrame([(1, None), (9, "a")], "n int, s string")
    rules = [{"name": "r", "type": "not_null", "column": "s"}, {"name": "r", "type": "range", "column": "n", "max": 100}, {"name": "r", "type": "range", "column": "n", "max": 5}]
    got = quality.run_rules(df, rules)
    assert sorted((r.type, r.violations) for r in got.collect()) == [("not_null", 1), ("range", 0), ("range", 1)]
    assert quality.table_score(got).first()[0] == 33.33


def test_repeated_times(spark):
    days = [(f"2024-01-{d:02d}", 10.0, 1) for d in range(1, 20)] + [("2024-01-20", 19.0, 1), ("2024-01-20", 1.0, 2)]
    df = spark.createDataFrame([(*d, "g") for d in days], "d string, y double, at int, g string")
    assert checks.forecast(df, "d", "y", ["g"], "2024-01-20", collected="at").first().actual == 1.0
    series = spark.createDataFrame([("2024-01-01", 5.0, 1, None), ("2024-01-01", 3.0, 2, None), ("2024-01-02", 6.0, 1, None), ("2024-01-02", 6.0, 1, "x")], "d string, v double, at int, g string")
    got = {(r.g, r.d): (r.past_n, r.past_mean) for r in checks.drift(series, "d", "v", "P1D", ["g"], past=1, collected="at").collect() if r.d.endswith("2")}
    assert got == {(None, "2024-01-02"): (1, 3.0), ("x", "2024-01-02"): (0, None)}
    assert checks.drift(series, "d", "v", "P1D", past=2).where("d = '2024-01-02'").first().past_n == 1


def test_append_after_rename(spark, tmp_path):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(spark.createDataFrame([(1, "x", 2)], "k int, a string, z int"))
    t.alter(rename={"a": "b"}, drop=["z"])
    for again in ("k int, a int", "k int, z int"):
        with pytest.raises(ValueError, match="renamed before"):
            t.append(spark.createDataFrame([(2, 3)], again))
    assert t.read().collect() == [(1, "x")]
    t.compact()
    t.append(spark.createDataFrame([(2, 3)], "k int, a int"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "x", None), (2, None, 3)]


def test_fields_that_come_late(spark):
    rows = [{"a": i} for i in range(1500)] + [{"a": 1.5, "b": {"c": ["x"]}, "n": None}] * 3
    df = readers.dicts_to_frame(spark, rows, infer=True, at_once=400)
    assert dict(df.dtypes) == {"a": "double", "b": "struct<c:array<string>>", "n": "string"}
    assert df.where("b is not null").count() == 3 and df.agg(F.sum("a")).first()[0] == sum(range(1500)) + 4.5


def test_batches_keep_the_last_row(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    merge_one = streaming.merge_batches(path, ["k"], "at")
    merge_one(spark.createDataFrame([(1, 9, 1), (1, 2, 5), (2, 7, 1)], "k int, v int, at int"), 0)
    merge_one(spark.createDataFrame([(1, 0, 6), (1, 8, 5)], "k int, v int, at int"), 1)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 0, 6), (2, 7, 1)]


def test_gz_rows_are_dealt(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("x\n" + "\n".join(map(str, range(1000))))
    df = readers.read_gz_csv(spark, f"file://{tmp_path}/*.gz", "x int", parts=4)
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("x")).first()[0] == 499500


def test_replay(spark, tmp_path):
    rows = [
        ("r1", "d", "rule.a", "m", None, "2024-01-01", "2024-01-02 00:00:00", "ERROR", "old", "true"),
        ("r2", "d", "rule.a", "m", None, "2024-01-01", "2024-01-03 00:00:00", "PASS", "new", "true"),
        ("r2", "d", "rule.b", "m", "x", "2024-01-01", "2024-01-03 00:00:00", "odd", "b", "true"),
        ("r2", "d", "rules", "m", None, "2024-01-01", "2024-01-03 00:00:00", "ERROR", "another name", "true"),
        ("r2", "d", "gone", "m", None, "2024-01-01", "2024-01-03 00:00:00", "ERROR", "gone", "false"),
        ("r2", "e", "rule", "m", None, "2024-01-02", "2024-01-03 00:00:00", "ERROR", "e", "true"),
    ]
    cols = "run_id string, dataset_name string, validation_name string, metric_name string, dimension_value string, partition_ts string, run_timestamp string, validation_status string, validation_message string, is_active string"
    kept = history.append_history(spark.createDataFrame(rows, cols).withColumn("record_type", F.lit("validation")), f"file://{tmp_path}/h")
    asked = spark.createDataFrame([("d", "rule", "2024-01-01"), ("d", "rule", "2024-01-01"), ("d", "gone", "2024-01-01"), ("e", "rule", "2024-01-01"), ("e", "rule", "2024-01-02"), ("f", "rule", None)], "dataset_name string, validation_name string, p string").select("dataset_name", "validation_name", F.col("p").cast("timestamp").alias("partition_ts"))
    asked_for = []

    def validate(missing):
        asked_for.extend(sorted((r.dataset_name, r.validation_name) for r in missing.collect()))
        return missing.select("*", F.lit("m").alias("metric_name"), F.lit(None).cast("string").alias("dimension_value"), F.lit(0).alias("severity"), F.lit("made").alias("message"))

    got = sorted((r.dataset_name, r.validation_name, r.severity, r.message, r.from_cache) for r in history.replay(kept, asked, validate).collect())
    assert got == [("d", "gone", 0, "made", False), ("d", "rule.a", 0, "new", True), ("d", "rule.b", 1, "b", True), ("e", "rule", 0, "made", False), ("e", "rule", 2, "e", True), ("f", "rule", 0, "made", False)]
    assert asked_for == [("d", "gone"), ("e", "rule"), ("f", "rule")]


def test_slices_within_a_budget(spark):
    df = spark.createDataFrame([(1.0, True, "x", 0), (3.0, None, "y", 0), (10.0, False, "z", 1), (None, False, "z", 2)], "a double, b boolean, s string, _period int")
    out = models.explain_slices(df, ["a", "b", "s"])
    got = {(r.column_name, r.stat, r.slice): r.value for r in out.collect()}
    assert got["a", "mean", 0] == 2 and got["b", "mean", 0] == 1 and got["a", "null_pct", 2] == 100 and got["a", "mean", 2] is None and len(got) == 18
    told = {r.column_name: (r.details_json, r.truncated) for r in models.within_budget(out, ["b", "a"], 10**6).collect()}
    size = len(told["b"][0].encode())
    assert not told["a"][1] and json.loads(told["b"][0])[0]["stat"] == "mean"
    short = {r.column_name: (r.details_json, r.truncated) for r in models.within_budget(out, ["b", "a"], size).collect()}
    assert short == {"b": (told["b"][0], False), "a": (None, True)}
    assert models.explain_slices(df, ["s"]).count() == 0


def test_exact_quantiles(spark):
    """Windows narrow to 50 rows, with ties, crowds at both ends, NaN, NULL and an empty column; the plans have no aggregate that holds a column's values."""
    rows = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("a"), (F.col("id") % 3).alias("ties"), F.expr("if(id % 100 = 0, id, if(id % 2 = 0, -1, 1000000))").alias("ends"), F.expr("if(id % 4 = 0, if(id % 8 = 0, double('NaN'), null), -id / 7)").alias("gaps"), F.lit(None).cast("double").alias("none"))
    asked = (0.0, 0.01, 0.5, 0.505, 0.99, 1.0)
    got = quality.exact_quantiles(rows, ["a", "ties", "ends", "gaps", "none"], asked, most=50)
    assert "percentile" not in got._jdf.queryExecution().toString()
    pdf = rows.toPandas().astype(float)
    want = {}
    for c in ("a", "ties", "ends", "gaps"):
        v = sorted(pdf[c].dropna())
        want |= {(c, q): v[max(1, -(-round(q * 1000) * len(v) // 1000)) - 1] for q in asked}
    assert {(r.column_name, r.quantile): r.value for r in got.collect()} == want
    assert quality.exact_quantiles(rows.limit(0), ["a"], asked).collect() == []
