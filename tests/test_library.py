import glob
import os
import random
import re
import zipfile
from fractions import Fraction

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle import functions, sources, streaming
from heddle.operators import merge, quality
from heddle.plans import ORACLE_SQL, QUERIES, workload


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def rows(df):
    cell = lambda x: "" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, db):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(db.execute(ORACLE_SQL[name]).df())


def test_rule_foreign_key_reads_every_customer(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(1, 12)], "c_custkey long").write.parquet(f"file://{tmp_path}/customer.parquet")
    spark.createDataFrame([(i,) for i in (1, 2, 4, 6, 8, 9, 11)], "o_custkey long").write.parquet(f"file://{tmp_path}/orders.parquet")
    got = QUERIES["rule_foreign_key"](spark, str(tmp_path)).collect()
    assert sorted(r.c_custkey for r in got) == [3, 5, 7, 10]


def test_merge_into_rejects_two_matches(spark):
    with pytest.raises(Exception, match="more than one source row"):
        merge.merge_into(spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3), (1, 4)], "k int, v int"), ["k"]).collect()


def test_mask_reads_every_value(spark):
    late = spark.range(5000).selectExpr("id", "case when id >= 4000 then 'Customer#1' end as sparse", "case when id < 1200 then 'x' else 'Customer#1' end as late", "case when id < 1200 then 'Customer#1' else 'x' end as early", "cast(null as string) as none")
    got = merge.mask(late.coalesce(1), {"customer": r"^Customer#\d+$"}).where("id = 4500").first()
    assert got.asDict() == {"id": 4500, "sparse": "Xxxxxxxx#n", "late": "Xxxxxxxx#n", "early": "x", "none": None}


def test_all_date_formats_over_all_orders(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    text = orders.select("o_orderdate", workload.dates_as_text(F.col("o_orderkey"), F.col("o_orderdate")).alias("x"))
    got = text.select("x", (functions.parse_date(F.col("x")) == F.col("o_orderdate").cast("date")).alias("same")).collect()
    assert all(r.same for r in got) and len(got) == orders.count()
    assert {re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", r.x)) for r in got} == {"0000-00-00", "00/00/0000", "00-aaa-0000", "00000000"}


def test_scd2_null_changes(spark):
    dim = spark.createDataFrame([(1, None, "2020-01-01", None, True), (2, "a", "2020-01-01", None, True)], "k int, v string, start_date string, end_date string, is_current boolean")
    dim = dim.withColumn("start_date", F.col("start_date").cast("date")).withColumn("end_date", F.col("end_date").cast("date"))
    got = merge.scd2(dim, spark.createDataFrame([(1, "x"), (2, "a")], "k int, v string"), ["k"], ["v"], "2024-01-02").orderBy("k", "start_date").collect()
    assert [(r.k, r.v, r.is_current) for r in got] == [(1, None, False), (1, "x", True), (2, "a", True)]


def test_versions(spark, tmp_path):
    t = sources.VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.append(spark.createDataFrame([(3, "c", 1.0)], "k int, v string, w double"))
    t.restore(0)
    assert t.versions() == [0, 1, 2] and t.read(1).count() == 3 and t.read().columns == ["k", "v"]
    kinds = sorted(r[0] for r in t.changes(["k"], 1).select("_change_type").collect())
    assert kinds.count("delete") == 1


def test_safe_overwrite_reads_itself(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    spark.range(5).write.parquet(path)
    sources.safe_overwrite(spark.read.parquet(path).where("id > 1"), path)
    assert spark.read.parquet(path).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|b\n")
    assert sources.read_delimited(spark, str(tmp_path / "a.csv"), "|", "x int, y string").collect() == [(1, "b")]
    pages = [{"items": [{"a": 1}, {"a": 2}], "hasMore": True}, {"items": [{"a": 3}], "hasMore": False}]
    got = sources.rows_to_frame(spark, sources.paged(lambda o, n: pages[0 if o == 0 else 1]), "a int")
    assert sorted(r.a for r in got.collect()) == [1, 2, 3]
    target = spark.createDataFrame([], "A long, b string").schema
    assert sources.align_to_target(spark.createDataFrame([(1,)], "a int"), target).collect() == [(1, None)]
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1"><v>1</v></c><c r="C1" t="inlineStr"><is><t>hi</t></is></c></row></sheetData></worksheet>')
    assert sources.read_xlsx(str(tmp_path / "s.xlsx")) == [[1, None, "hi"]]


def test_stream_counts(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"file://{tmp_path}/in")
    stream = streaming.file_stream(spark, f"file://{tmp_path}/in")
    seen = []
    streaming.run_available(stream.groupBy("event_type").count(), lambda df, _: seen.append(df.agg(F.sum("count")).first()[0]), str(tmp_path / "c"), "complete")
    assert seen[-1] == 1000


def test_verdicts(spark):
    df = spark.createDataFrame([(None,), (5.0,), (50.0,), (500.0,)], "v double")
    got = [r[0] for r in df.select(quality.severity(F.col("v"), {"max": 100}, {"min": 10})).collect()]
    assert got == [1, 1, 0, 2]


def test_having_by_exact_means(spark, tmp_path):
    sets = {1: [0.05] * 127 + [0.06], 2: [0.06] + [0.05] * 127, 3: [0.03, 0.07], 4: [0.1, 0.0, 0.05] * 200}  # 1 and 2: 0.050078125, 3 and 4: 0.05
    spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "l_suppkey long, l_discount double").coalesce(1).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, QUERIES["ag_having"](spark, str(tmp_path)).collect())) == [(1, 0.05007813), (2, 0.05007813)]


def test_labels_by_exact_sums(spark, tmp_path):
    draw = random.Random(1)
    sets = {}
    while len(sets) < 40:  # means of 0.05 in hundredths; the doubles' own are a little less or not
        v = [draw.randrange(11) for _ in range(9)]
        if 0 <= 50 - sum(v) <= 10:
            sets[len(sets)] = [x / 100 for x in [*v, 50 - sum(v)]]
    rows = [(k, i, 30.0, x, 0.01) for k, v in sets.items() for i, x in enumerate(v)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    got = {r.l_suppkey: r.label for r in QUERIES["ag_labels"](spark, str(tmp_path)).collect()}
    assert got == {k: "strong" if sum(map(Fraction, v)) < 10 * Fraction(0.05) else "steady" for k, v in sets.items()}


def test_custom_profile_counts_no_keys(spark, tmp_path):
    spark.createDataFrame([(400_000, 500_000, 300_001.0), (400_001, 1, 300_000.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"file://{tmp_path}/orders.parquet")
    assert {r.column_name: r.value for r in QUERIES["profile_custom"](spark, str(tmp_path)).collect()} == {"o_orderkey": 0, "o_custkey": 0, "o_totalprice": 1}
