"""Operators that no SQL of the registered queries holds: tables and their upkeep, readers, lifecycles, models, odd rows."""

import datetime as dt
import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle import api, cli, sources, streaming
from heddle.functions import scores, text
from heddle.operators import checks, history, lifecycle, merge, models, quality
from heddle.sources import generator, readers, tables


def at(path):
    return f"file://{path}"


def test_versions_and_columns(spark, tmp_path):
    t = sources.VersionedTable(spark, at(tmp_path / "t"))
    t.commit(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.append(spark.createDataFrame([(3, "c", 1.0)], "k int, v string, w double"))
    t.alter(rename={"v": "name"}, drop=["w"], add={"size": "int"})
    t.append(spark.createDataFrame([(4, "d", 9)], "k int, name string, size int"))
    assert sorted(t.read().collect()) == [(1, "a", None), (2, "b", None), (3, "c", None), (4, "d", 9)]
    assert sorted(t.read(1).collect(), key=lambda r: r.k)[0] == (1, "a", None) and t.read(0).columns == ["k", "v"]
    with pytest.raises(ValueError, match="dropped before"):
        t.alter(add={"w": "double"})
    folders = t.entry()["folders"]
    assert len(folders) == 3
    t.compact("k")
    assert sorted(t.read().collect())[-1] == (4, "d", 9)
    now = spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
    assert t.read(as_of=now).count() == 4 and [r.operation for r in t.history().orderBy("version").collect()] == ["overwrite", "append", "alter", "append", "compact"]
    assert sorted(t.vacuum(1)) == sorted(folders) and t.read().count() == 4
    with pytest.raises(Exception):
        t.read(0).count()


def test_change_consumption(spark, tmp_path):
    t = sources.VersionedTable(spark, at(tmp_path / "t"))
    t.commit(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.commit(spark.createDataFrame([(1, "x"), (3, "c")], "k int, v string"))
    seen = []
    state = at(tmp_path / "state")
    counts = t.consume(["k"], state, lambda df: seen.append(df.count()))
    assert counts == {"insert": 1, "delete": 1, "update_preimage": 1, "update_postimage": 1} and seen == [4]
    assert t.consume(["k"], state, lambda df: seen.append(df.count())) == {} and seen == [4]


def test_write_modes(spark, tmp_path):
    path = at(tmp_path / "w")
    tables.write_mode(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "CREATE")
    with pytest.raises(Exception):
        tables.write_mode(spark.range(1), path, "CREATE")
    tables.write_mode(spark.createDataFrame([(2, "z"), (3, "c"), (None, "n"), (None, "m")], "k int, v string"), path, "MERGE", ["k"])
    assert sorted(spark.read.parquet(path).collect(), key=str) == sorted([(1, "a"), (2, "z"), (3, "c"), (None, "n"), (None, "m")], key=str)
    tables.write_mode(spark.read.parquet(path).where("k > 1"), path, "OVERWRITE")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        tables.write_mode(spark.range(1), path, "UPSERT")


def test_sized_and_keys(spark, tmp_path):
    assert tables.write_sized(spark.range(1000).repartition(6), at(tmp_path / "s")) == 1
    assert tables.materialise(spark.range(10)).count() == 10
    got = tables.surrogate_keys(spark.range(500).select((F.col("id") % 7).alias("k"), F.lit(1).alias("c")), ["k"], 10).collect()
    assert sorted(r.id for r in got) == list(range(11, 511)) and [r.k for r in sorted(got, key=lambda r: r.id)] == sorted(r.k for r in got)


def test_catalog_tables(spark, tmp_path):
    a = tables.bucketed(spark.range(1000).select((F.col("id") % 50).alias("k"), "id"), "heddle_a", 4, "k")
    b = tables.bucketed(spark.range(50).select(F.col("id").alias("k")), "heddle_b", 4, "k")
    plan = a.hint("merge").join(b, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and a.join(b, "k").count() == 1000
    tables.set_properties(spark, "heddle_b", {"steward": "it's me", "rules": {"a": [1]}})
    found = tables.properties(spark, "heddle_b")
    assert found["steward"] == "it's me" and json.loads(found["rules"]) == {"a": [1]}
    tables.unset_properties(spark, "heddle_b", "steward")
    assert "steward" not in tables.properties(spark, "heddle_b")
    assert ("default.heddle_b", "k", "bigint") in readers.describe_catalog(spark, "default") and readers.location(spark, "heddle_b").endswith("heddle_b")
    spark.sql("CREATE TABLE heddle_c (id bigint, note string) USING parquet")
    tables.insert_into(spark.createDataFrame([("x", 5)], "note string, ID int"), "heddle_c")
    assert spark.table("heddle_c").collect() == [(5, "x")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.psv").write_text("k|v\n1|a\n")
    assert readers.external_table(spark, "heddle_d", at(tmp_path / "p"), "k int, v string").collect() == [(1, "a")]
    for x in "abcd":
        spark.sql(f"DROP TABLE heddle_{x}")


def test_readers(spark, tmp_path):
    (tmp_path / "z").mkdir()
    for i in range(2):
        with gzip.open(tmp_path / "z" / f"p{i}.csv.gz", "wt") as f:
            f.write(f"a,b\n{i},x\n")
    assert readers.read_gz_csv(spark, at(tmp_path / "z" / "*.csv.gz")).agg(F.sum("a")).first()[0] == 1
    assert readers.read_gz_csv(spark, at(tmp_path / "z" / "*.csv.gz"), "a int, b string").count() == 2
    (tmp_path / "m.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.read_json(spark, at(tmp_path / "m.json"), multiline=True).count() == 2
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.TXT").write_bytes(b"hi \xff")
    (tmp_path / "d" / "y.bin").write_bytes(b"0")
    got = readers.read_binary(spark, at(tmp_path / "d"), ["txt"]).select(text.decode_text(F.col("content")).alias("t")).collect()
    assert len(got) == 1 and got[0].t.startswith("hi ")
    assert readers.dicts_to_frame(spark, []).columns == ["json_string"] and readers.dicts_to_frame(spark, [], "a int").columns == ["a"]
    assert sorted(r.a for r in readers.dicts_to_frame(spark, ({"a": i} for i in range(25)), infer=True, at_once=10).collect()) == list(range(25))
    assert readers.read(spark, "json", path=at(tmp_path / "m.json"), multiLine=True).count() == 2
    with pytest.raises(ValueError, match="no reader"):
        readers.read(spark, "ftp")
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        row = lambda *v: "<row>" + "".join(f'<c r="{chr(65 + i)}1" t="inlineStr"><is><t>{x}</t></is></c>' for i, x in enumerate(v)) + "</row>"
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{row("a", "b")}{row("1", "x")}{row("2", "y")}</sheetData></worksheet>')
    assert sources.xlsx_to_frame(spark, at(tmp_path / "s.xlsx")).collect() == [("1", "x"), ("2", "y")]


def test_connector_options():
    o = readers.jdbc_options("mysql", "h", 3306, "d", "t", "u", "p", columns=["a"], where="a > 1", partition={"column": "a", "num": 4, "lower": 0, "upper": 9}, row_limit=5)
    assert o["url"] == "jdbc:mysql://h:3306/d" and o["dbtable"] == "(SELECT a FROM t WHERE a > 1 LIMIT 5) q" and o["numPartitions"] == "4" and o["fetchsize"] == "10000"
    with pytest.raises(ValueError, match="read-only"):
        readers.jdbc_options("snowflake", "h", 1, "d", "t", write=True)
    k = readers.kafka_options("s:9092", "t", "u", "p", "earliest", most_per_trigger=5)
    assert k["kafka.security.protocol"] == "SASL_SSL" and 'username="u"' in k["kafka.sasl.jaas.config"] and k["maxOffsetsPerTrigger"] == "5"


def test_ingest(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").write.parquet(at(tmp_path / "in"))
    source = {"name": "s", "format": "parquet", "path": at(tmp_path / "in"), "columns": ["k", "v"], "sql": "SELECT k, upper(v) AS v FROM {source}", "filter": "k < 2", "checks": [{"name": "v", "type": "not_null", "column": "v"}], "target": at(tmp_path / "out"), "partition_by": ["k"]}
    assert readers.ingest(spark, source).select("v").collect() == [("A",)]
    with pytest.raises(quality.GateError, match="'v', 1"):
        readers.ingest(spark, source | {"filter": None})
    with pytest.raises(ValueError, match="expected columns"):
        readers.ingest(spark, source | {"columns": ["k"]})


def test_generator(spark):
    made = generator.generate(
        spark,
        [
            {"name": "b", "rows": 400, "columns": [{"name": "a.id", "type": "integer"}, {"name": "u", "type": "uuid"}, {"name": "p", "type": "phone"}, {"name": "d", "type": "date", "start": "2024-01-01", "end": "2024-01-31"}, {"name": "t", "type": "datetime"}, {"name": "f", "type": "float", "range": [0, 1], "decimals": 3, "unique": True}, {"name": "ok", "type": "boolean"}, {"name": "c", "type": "choice", "values": ["x", "y", "z"], "weights": [8, 1, 1]}]},
            {"name": "a", "rows": 20, "columns": [{"name": "id", "type": "integer", "range": [5, 24], "unique": True}, {"name": "s", "type": "string", "length": 3, "chars": "ab", "prefix": "p", "suffix": "s"}]},
        ],
    )
    a, b = made["a"].toPandas(), made["b"].toPandas()
    assert sorted(a["id"]) == list(range(5, 25)) and a["s"].str.fullmatch("p[ab]{3}s").all()
    assert set(b["a.id"]) <= set(a["id"]) and b["u"].nunique() == 400 and b["f"].nunique() == 400 and b["f"].between(0, 1).all() and b["p"].str.fullmatch(r"\+1-\d{3}-\d{3}-\d{4}").all()
    assert (b["c"] == "x").mean() > 0.7 and set(b["c"]) == {"x", "y", "z"} and b["d"].astype(str).between("2024-01-01", "2024-01-31").all()
    assert made["b"].toPandas().equals(b)
    with pytest.raises(ValueError, match="cycle"):
        generator.generate(spark, [{"name": n, "rows": 1, "columns": [{"name": "r", "type": "reference", "ref_table": m, "ref_column": "r"}]} for n, m in ("ab", "ba")])
    with pytest.raises(ValueError, match="different values"):
        generator.generate(spark, [{"name": "a", "rows": 9, "columns": [{"name": "i", "type": "integer", "range": [0, 3], "unique": True}]}])


def test_text_tools(spark):
    assert text.both_filters(" ", None) is None and text.both_filters("a OR b", "c") == "(a OR b) AND (c)"
    assert text.render("p='{{ ds | date_add(-1) | date_format('%Y%m%d') }}'", {"ds": dt.date(2024, 3, 1)}) == "p='20240229'"
    with pytest.raises(KeyError):
        text.render("{{ nope }}", {})
    assert text.guard_select("SELECT created_at FROM t") == "SELECT created_at FROM t\nLIMIT 100" and text.guard_select("with x as (select 1) select * from x limit 3;").endswith("limit 3")
    assert text.guard_select("select 'drop; table' as x").startswith("select")
    for bad in ("DELETE FROM t", "select 1; drop table t", "select * from (delete from t)", ""):
        with pytest.raises(ValueError):
            text.guard_select(bad)
    assert text.summarise(lambda p: p.splitlines()[-1], "how many?", spark.range(1)) == "{'id': 0}"
    assert [r[0] for r in spark.range(1).select(scores.money(F.lit("$1,234.50"))).collect()] == [1234.5]


def test_rules_on_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (1, "b"), (2, "b")], "k int, v string")
    assert quality.completeness(df.limit(0), "v").first() == (100.0, True) and round(quality.completeness(df, "v", 70).first()[0], 2) == 66.67
    assert quality.type_matches(df, "k", "bigint") and not quality.type_matches(df, "k", "integer") and quality.type_matches(df, "k", "integer", by_name=True)
    assert quality.schema_drift(df, {"k": "bigint", "z": "int"}) == [("k", "bigint", "int"), ("z", "int", "MISSING")]
    assert quality.volume(df, df.limit(0), 1, 2).first().status == "FAIL" and quality.volume(df.limit(0), df.limit(0), 1, 2).first().status == "PASS"
    assert quality.table_score(quality.run_rules(df, [])).first()[0] == 100.0
    assert quality.run_rules(df, [{"name": "m", "type": "llm", "column": "v", "instruction": "ok?"}], ask=lambda p: "maybe").first().status == "FAIL"
    assert quality.profile(df, columns=[]).count() == 0 and quality.profile(df.limit(0), ["v"], ["null_pct", "avg_length"]).where("value is not null").count() == 0
    with pytest.raises(quality.GateError):
        quality.gate(df, [{"name": "u", "type": "unique", "column": "k"}])


def test_approximate_profile(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = {(r.column_name, r.stat): r.value for r in quality.profile(li, stats=["approx_distinct", "quantiles"]).collect()}
    for c in ("l_partkey", "l_suppkey", "l_returnflag"):
        exact = li.select(c).distinct().count()
        assert abs(got[c, "approx_distinct"] - exact) <= max(0.1 * exact, 1)
    assert abs(got["l_quantity", "p50"] - li.approxQuantile("l_quantity", [0.5], 0)[0]) <= 1


def test_samples(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    a, b = checks.hash_split(e, [0.7, 0.3], ["event_id"])
    assert a.count() + b.count() == e.count() and a.join(b, "event_id", "left_semi").count() == 0 and 0.6 < a.count() / e.count() < 0.8
    s = checks.slices(e, "ts", "2024-01-22", "P7D", 3, 20, key=["event_id"])
    days = {(r._period, str(r.ts)[:10]) for r in s.collect()}
    assert days == {(0, "2024-01-22"), (1, "2024-01-15"), (2, "2024-01-08"), (3, "2024-01-01")} and s.groupBy("_period").count().agg(F.max("count")).first()[0] <= 20
    with pytest.raises(ValueError):
        checks.slices(e, "ts", None, "P1D")
    from heddle.plans import QUERIES

    first, again = ([r.event_id for r in QUERIES["sl_hash_sample"](spark, sf).collect()] for _ in range(2))
    assert first == again and len(set(first)) == 100
    counts = {r.event_type: r.users for r in QUERIES["ag_approx_distinct"](spark, sf).collect()}
    for r in e.groupBy("event_type").agg(F.count_distinct("user_id").alias("n")).collect():
        assert abs(counts[r.event_type] - r.n) <= 0.1 * r.n + 1


def test_drift_strategies(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    s = spark.createDataFrame([(day(1), 10.0), (day(2), 20.0), (day(4), 30.0), (day(5), None)], "d timestamp, v double")
    row = lambda n, **k: {r.d.day: r for r in checks.drift(s, "d", "v", "P1D", past=2, **k).collect()}[n]
    assert row(1).severity == 0 and row(1, none="error").severity == 2 and row(5).severity == 1
    r = row(4)  # day 3 is missing: only day 2 counts
    assert (r.past_n, r.deviation_abs, r.deviation_pct, r.z_score, r.rate_of_change_pct) == (1, 10.0, 50.0, 0.0, 50.0)
    assert row(4, short="error").severity == 2 and row(4, error={"deviation_pct": {"max": 49}}).severity == 2 and row(4, warning={"deviation_pct": {"min": -10, "max": 60}}).severity == 0
    assert row(2, warning={"rate_of_change_abs": {"max": 9}}).severity == 1


def test_durations_and_pairs():
    assert checks.step_seconds("P1W") == 604800 and checks.step_seconds("P2DT12H") == 216000 and checks.step_seconds("pt30m") == 1800
    for bad in ("7D", "P1M", "P", "PT", "1H"):
        with pytest.raises(ValueError):
            checks.step_seconds(bad)
    checks.check_pair("aggregation", "drift")
    with pytest.raises(ValueError):
        checks.check_pair("recency", "drift")
    assert checks.redact(["a", "b", "c"], deny=["b"], allow=["a", "b"]) == ["a", "***", "***"]


def test_slo_is_strict(spark):
    newest = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "recency_ts timestamp")
    assert checks.slo(newest, F.lit("2024-01-01 01:00:00"), "PT1H", "P1D").first().severity == 0
    assert checks.slo(newest, F.lit("2024-01-01 01:00:01"), "PT1H", "P1D").first().severity == 1
    assert checks.slo(newest.select(F.lit(None).cast("timestamp").alias("recency_ts")), F.lit("2024-01-01"), "PT1H").first().severity == 2


def test_forecast(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    wave = lambda i: 100 + i + 20 * (i % 7 == 0)
    rows = [("good", d, float(wave(i))) for i, d in enumerate(days)] + [("bad", d, 300.0 if i == 59 else float(wave(i))) for i, d in enumerate(days)] + [("new", days[59], 1.0)]
    got = {r.k: r for r in checks.forecast(spark.createDataFrame(rows, "k string, d timestamp, v double"), "d", "v", ["k"], str(days[59])).collect()}
    assert got["bad"].severity == 2 and abs(got["good"].yhat - wave(59)) < 8 and got["new"].severity == 0 and got["new"].yhat is None


def test_isolation_forest(spark):
    rows = [(float(i % 10), float(i % 7), 1) for i in range(500)] + [(1000.0, -500.0, 0)] * 5 + [(float(i % 10), 3.0, 0) for i in range(45)]
    df = spark.createDataFrame(rows, "a double, b double, _period int")
    encoded, _ = models.encode(df, ["a", "b"], ["_period", "a"])
    scored = models.isolation_scores(encoded, trees=20).groupBy(F.col("a") > 100).agg(F.avg("anomaly_score").alias("s")).collect()
    s = {r[0]: r.s for r in scored}
    assert s[True] > s[False] + 0.1
    got = models.shape_check(df, ["a", "b", "_period"], trees=20).first()
    assert got.total_current == 50 and 5 <= got.anomaly_count < 50
    with pytest.raises(ValueError, match="repeat"):
        models.encode(df, ["a", "a"])


def test_two_samples(spark):
    same = spark.range(400).select((F.col("id") % 2).cast("int").alias("_period"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)).cast("string").alias("s"))
    moved = same.withColumn("x", F.col("x") + F.when(F.col("_period") == 0, 80).otherwise(0))
    a, b = (models.pattern_check(d, ["x", "s"], folds=3, trees=10) for d in (same, moved))
    assert a["auc"] < 0.65 and a["severity"] == 0 and b["auc"] > 0.9 and b["severity"] == 2 and b["importances"][0][0] == "x"
    assert models.pattern_check(same.limit(3), ["x"], folds=3)["severity"] == 1


def test_learners(spark, sf):
    rows = spark.range(600).select((F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("noise"))
    rows = rows.withColumn("label", (F.col("x") > 4).cast("double")).withColumn("y", F.col("x") * 3 + F.col("noise") / 100)
    assert models.evaluate(models.train_classifier(rows, "label", ["k"], ["x", "noise"], trees=5).transform(rows), "label")["auc"] > 0.95
    assert models.evaluate(models.train_classifier(rows, "label", [], ["x", "noise"], layers=[4]).transform(rows), "label")["accuracy"] > 0.9
    assert models.evaluate(models.train_regressor(rows, "y", ["k"], ["x"], trees=5).transform(rows), "y", regression=True)["r2"] > 0.8
    ratings = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(8) for i in range(10) if (u + i) % 3], "u int, i int, r float")
    best, error = models.recommend(ratings, "u", "i", "r", 2)
    assert error < 2 and best.join(ratings, ["u", "i"], "left_semi").count() == 0 and best.groupBy("u").count().agg(F.max("count")).first()[0] <= 2
    group = spark.range(2000).select((F.col("id") % 20).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("x"))
    group = group.withColumn("y", 5 + 2 * F.col("x") + (F.pmod("g", F.lit(5)) - 2) * 3 + (F.pmod(F.xxhash64("g", "x", F.lit(7)), F.lit(100)) - 49.5) / 50)
    fit = models.mixed_effects(group, "y", "x", "g")
    assert abs(fit["slope"] - 2) < 0.01 and abs(fit["intercept"] - 5) < 0.5 and 10 < fit["group_variance"] < 30 and fit["residual_variance"] < 1


def test_best_unrated(monkeypatch):
    """Equal to all scores sorted, with ties, negative factors, users who have rated nearly all and fewer items than asked for."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(models, "_BOX", 16)
    monkeypatch.setattr(models, "_GROUP", 32)
    for users, items, low in ((100, 500, 0), (70, 333, -1), (40, 3, 0)):
        u, v = (np.round(rng.uniform(low, 1, (k, 8)) * 4) / 4 for k in (users, items))
        u[0] = 0  # every item ties
        ids = rng.permutation(10 * items)[:items].astype(np.int32)
        seen = rng.random((users, items)) < 0.1
        seen[1, 1:] = True
        at, pos = np.nonzero(seen)
        got = sorted(zip(*(x.tolist() for x in models.best_unrated(u, v, ids, at, ids[pos], 4))))
        score = (u @ v.T).astype(np.float32)
        want = sorted((r, int(i), float(s)) for r in range(users) for s, i in sorted(((float(score[r, k]), ids[k]) for k in range(items) if not seen[r, k]), key=lambda x: (-x[0], x[1]))[:4])
        assert got == want


def test_best_unrated_passes_by(monkeypatch):
    """Of all pairs a twentieth at most is scored, and the result equals that of all scores sorted."""
    rng = np.random.default_rng(4)
    u, v = rng.gamma(2, 1, (2048, 8)), rng.gamma(2, 1, (40_000, 8))
    scored, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *k, **b: scored.append(np.size(a)) or partition(a, *k, **b))
    got = sorted(zip(*(x.tolist() for x in models.best_unrated(u, v, np.arange(40_000, dtype=np.int32), np.empty(0, np.int64), np.empty(0, np.int32), 2))))
    best = np.argsort(-(u @ v.T).astype(np.float32), axis=1, kind="stable")[:, :2]
    assert [(r, i) for r, i, _ in got] == sorted((r, i) for r in range(2048) for i in best[r].tolist())
    assert sum(scored) < 2048 * 40_000 / 20


def test_recommend_by_parts(spark, monkeypatch):
    """Parts and blocks of any size change no result, for users who have rated most items too."""
    ratings = spark.range(40 * 300).selectExpr("cast(id % 40 as int) u", "cast(id div 40 as int) i").where("pmod(xxhash64(u, i), 10) < 8").selectExpr("*", "cast(pmod(xxhash64(i, u), 5) as float) r")
    seen = {(r.u, r.i) for r in ratings.select("u", "i").collect()}
    runs = []
    for rows in (1 << 18, 64):
        monkeypatch.setattr(models, "ITEM_ROWS", rows)
        monkeypatch.setattr(models, "USER_ROWS", rows // 4)
        runs.append({(r.u, r.i, r["rank"]) for r in models.recommend(ratings, "u", "i", "r", 3)[0].collect()})
    assert runs[0] == runs[1] and len(runs[0]) == 120 and not {(u, i) for u, i, _ in runs[0]} & seen


def test_history_writer(spark, tmp_path):
    path = at(tmp_path / "h")
    rows = spark.createDataFrame([("d", "m", 1.5, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "dataset_name string, metric_name string, metric_value double, partition_ts timestamp, run_timestamp timestamp")
    h = history.append_history(rows, path)
    assert h.first().is_active == "true" and history.metric_history(h).count() == 1
    with pytest.raises(ValueError, match="schema"):
        history.append_history(rows.withColumn("extra", F.lit(1)), path)
    dead = history.tombstones(h, F.lit("2023-01-01"), "old clock")
    assert dead.first().run_timestamp > dt.datetime(2024, 1, 2)
    assert history.metric_history(history.append_history(dead, path)).count() == 0
    with pytest.raises(ValueError):
        history.validation_history(h, h, 0)


def test_lifecycle(spark, tmp_path):
    ok = spark.createDataFrame([("a", 0), ("b", 1)], "validation_name string, severity int")
    assert lifecycle.outcome(ok) == {"pass": 1, "warning": 1, "error": 0}
    with pytest.raises(lifecycle.ValidationFailed, match="c"):
        lifecycle.outcome(spark.createDataFrame([("c", 2)], ok.schema))
    target, staging = at(tmp_path / "t"), at(tmp_path / "staging")
    judge = lambda level: lambda df: df.limit(1).select(F.lit("n").alias("validation_name"), F.lit(level).alias("severity"))
    assert lifecycle.write_audit_publish(spark.range(5), target, staging, judge(1))["published"] and spark.read.parquet(target).count() == 5
    assert lifecycle.write_audit_publish(spark.range(9), target, staging, judge(2)) == {"published": False, "errors": ["n"], "warnings": []}
    assert spark.read.parquet(target).count() == 5 and not list((tmp_path / "staging").glob("wap-*"))
    with pytest.raises(ValueError, match="does not exist"):
        lifecycle.write_audit_publish(spark.range(1), at(tmp_path / "no"), staging, judge(0), allow_create=False)
    assert lifecycle.accept(spark, "SELECT 0", 2) == "PASS" and lifecycle.accept(spark, "SELECT 3", 1, 2) == "VIOLATED"
    assert lifecycle.layers({"c": ["a", "b"], "b": ["a"]}) == [["a"], ["b"], ["c"]]
    names = ["d:v:m", "d:w:m", "e:v:n"]
    assert lifecycle.select(names, ["d:*:m"]) == ["d:v:m", "d:w:m"] and lifecycle.select(names, ["*:v"]) == ["d:v:m", "e:v:n"]
    with pytest.raises(ValueError, match="nothing"):
        lifecycle.select(names, ["x:y"])
    assert len(lifecycle.anchors("2024-01-01", "2024-01-03")) == 3 and len(lifecycle.anchors("", listed=["2024-01-05", "2024-01-05"])) == 1
    with pytest.raises(ValueError):
        lifecycle.anchors("2000-01-01", "2024-01-01", "PT1M")


def test_merge_carries(spark):
    base = spark.createDataFrame([("a", 1, "p", 10), ("b", 2, "p", 20), ("z", 9, "q", 90)], "k string, v int, part string, old int")
    new = spark.createDataFrame([("a", None, "p", "x"), ("c", 3, "p", "y")], "k string, v int, part string, more string")
    rows = lambda **o: sorted(tuple(r) for r in merge.merge_partitions(base, new, ["k"], ["part"], **o).collect())
    assert rows() == [("a", None, "p", None, "x"), ("b", 2, "p", 20, None), ("c", 3, "p", None, "y")]
    assert rows(carry=True, extra=False) == [("a", None, "p", 10), ("b", 2, "p", 20), ("c", 3, "p", None)]
    assert rows(deny=["v"], extra_deny=["more"])[0] == ("a", 1, "p", None)
    assert len(rows(delete_when=F.col("more") == "x")) == 2
    with pytest.raises(ValueError, match="lacks"):
        merge.merge_partitions(base, new.drop("part"), ["k"], ["part"])


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(at(tmp_path / "in"))
    stream = streaming.file_stream(spark, at(tmp_path / "in"))
    streaming.append_to(streaming.projected(stream, {"event_id": F.col("event_id")}, F.col("value") > 10), at(tmp_path / "out"), at(tmp_path / "c1"), every=None, name="copy").awaitTermination()
    assert spark.read.parquet(at(tmp_path / "out")).count() == events.where("value > 10").count()
    streaming.run_available(stream.select("user_id", "event_id", "value"), streaming.merge_batches(at(tmp_path / "merged"), ["user_id"]), at(tmp_path / "c2"))
    assert spark.read.parquet(at(tmp_path / "merged")).count() == events.select("user_id").distinct().count()
    seen = []
    windows = streaming.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "2 days", "event_type")
    streaming.run_available(windows, lambda df, _: seen.append(df.agg(F.sum("n")).first()[0] or 0), at(tmp_path / "c3"), "update")
    assert sum(seen) == events.count()
    streaming.run_available(streaming.first_seen(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "40 days", ["user_id"]).select("user_id"), at(tmp_path / "users"), at(tmp_path / "c4"))
    assert spark.read.parquet(at(tmp_path / "users")).count() == events.select("user_id").distinct().count()
    assert streaming.rate_stream(spark, 5, {"k": F.col("value") % 3}).isStreaming
    assert streaming.check_checkpoint("hdfs://x/y") == "hdfs://x/y"
    with pytest.raises(ValueError):
        streaming.check_checkpoint("/tmp/x")


def test_quality_runs(spark, sf, tmp_path, capsys):
    config = {"dataset": "events", "source": {"kind": "parquet", "path": f"{sf}/events.parquet"}, "at": "ts", "step": "P1D", "dims": ["event_type"], "metrics": {"n": "count(1)", "mean": "avg(value)"}, "rules": [{"name": "bounds", "metric": "n", "error": {"min": 1}, "warning": {"max": 5}}], "drift": [{"name": "moved", "metric": "n", "past": 2, "warning": {"deviation_pct": {"min": -90, "max": 400}}}], "trend": [{"name": "trend", "metric": "n", "warning": 0.9999999, "error": 0.99999999}], "slo": {"column": "ts", "warning": "P30D"}, "partition_ts": "2024-01-20"}
    assert api.check_config(config) == [] and len(api.check_config({"step": "1D", "rules": [{"metric": "x"}]})) == 7
    path, told = at(tmp_path / "h"), []
    q = api.Quality(spark, path, "2024-01-31")
    days = lifecycle.anchors("2024-01-10", "2024-01-19")
    assert {r.state for r in q.backfill(config, days).collect()} == {"added"}
    assert {r.state for r in q.backfill(config, days).collect()} == {"unchanged"}
    api.notifier("list")(lambda df: told.append(df.count()))
    try:
        got = q.run(config)
    finally:
        api.NOTIFIERS.clear()
    kinds = {r[0] for r in q.history().where("record_type = 'validation'").select("validation_type").distinct().collect()}
    assert got["error"] == 0 and got["pass"] > 0 and kinds == {"threshold", "drift", "trend", "slo"} and len(told) == 1
    report = {(r.section, r.key): r.total for r in q.health_report().collect()}
    assert report["summary", ""] == got["pass"] + got["warning"] == report["dataset", "events"]
    assert q.deactivate("wrong", dataset_name="events", metric_name="mean") > 0 and q.deactivate(dataset_name="events", metric_name="mean") == 0
    with pytest.raises(lifecycle.ValidationFailed):
        q.run(config | {"rules": [{"name": "b", "metric": "n", "error": {"min": 10**9}}]})
    out = q.write_audit_publish(q.frame(config), at(tmp_path / "pub"), at(tmp_path / "stage"), config | {"drift": [], "trend": []})
    assert out["published"] and spark.read.parquet(at(tmp_path / "pub")).count() == q.frame(config).count()
    assert q.shape_check(q.frame(config), "ts", "2024-01-22", "P7D", ["value", "event_type", "ts"], trees=10).first().total_current > 0
    file = tmp_path / "c.json"
    file.write_text(json.dumps(config))
    run = lambda *a: cli.main([*a, "--history", path, "--now", "2024-02-01"], spark)
    assert cli.main(["validate-config", str(file)]) == 0 and run("run", str(file)) == 0 and run("report") == 0 and run("backfill", str(file), "--start", "2024-01-10") == 0 and run("deactivate-metric", "--dataset", "events", "--metric", "n") == 0
    assert "summary" in capsys.readouterr().out


def test_failed_overwrite_comes_back(spark, tmp_path):
    path = at(tmp_path / "x")
    spark.range(3).write.parquet(path)
    (tmp_path / "x").rename(tmp_path / "x._old")
    sources.recover_overwrite(spark, path)
    assert spark.read.parquet(path).count() == 3
