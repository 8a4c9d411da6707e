"""Models on tables: encoding of features, isolation forests, two-sample tests, drift explained by column, and the workload's learners."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .attributions import Tree, attributions, explain, forest_trees, mean_contributions
from .quality import family

ONE_HOT = 20


def encode(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), drop_complex: bool = False) -> tuple[DataFrame, list[str]]:
    """(keep..., features array<double>) and the features' names.

    Booleans are 0 and 1, NULL as 0; numbers have their median for NULL; times are epoch seconds, NULL as 0; texts of at most 20 values
    have a column a value and one for NULL where there are any; texts of more values, and complex types unless dropped, have a code by
    hash. Repeated names are an error. What is learnt from the data, medians and short value lists, takes one aggregation.
    """
    if len(set(columns)) < len(columns):
        raise ValueError("column names repeat")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    of = {c: family(kinds[c]) for c in columns}
    stats = []
    for c in columns:
        x = F.col(f"`{c}`")
        if of[c] == "numeric":
            stats.append(F.percentile_approx(x.cast("double"), 0.5, 100_000).alias(f"m_{c}"))
        elif of[c] == "text":
            stats += [F.approx_count_distinct(x).alias(f"d_{c}"), F.count_if(x.isNull()).alias(f"n_{c}")]
    got = df.agg(*stats).first().asDict() if stats else {}
    few = [c for c in columns if of[c] == "text" and got[f"d_{c}"] <= 2 * ONE_HOT]  # an estimate: those near the bound are counted below
    values = {c: sorted(r[0] for r in df.where(F.col(f"`{c}`").isNotNull()).select(f"`{c}`").distinct().limit(ONE_HOT + 1).collect()) for c in few}
    names, parts = [], []
    for c in columns:
        x = F.col(f"`{c}`")
        if of[c] == "boolean":
            names.append(c)
            parts.append(F.coalesce(x.cast("double"), F.lit(0.0)))
        elif of[c] == "numeric":
            names.append(c)
            parts.append(F.coalesce(x.cast("double"), F.lit(float(got[f"m_{c}"] or 0.0))))
        elif of[c] == "time":
            names.append(f"{c}_timestamp")
            parts.append(F.coalesce(F.unix_seconds(x.cast("timestamp")).cast("double"), F.lit(0.0)))
        elif of[c] == "text" and len(values.get(c, range(ONE_HOT + 1))) <= ONE_HOT:
            names += [f"{c}_{v}" for v in values[c]] + [f"{c}_nan"] * bool(got[f"n_{c}"])
            parts += [F.coalesce((x == v).cast("double"), F.lit(0.0)) for v in values[c]] + [x.isNull().cast("double")] * bool(got[f"n_{c}"])
        elif of[c] == "text" or not drop_complex:
            names.append(c)
            parts.append(F.pmod(F.xxhash64(x.cast("string") if of[c] == "text" else F.to_json(F.struct(x))), F.lit(1 << 20)).cast("double"))
    features = F.array(*parts) if parts else F.array().cast("array<double>")
    return df.select(*keep, features.alias("features")), names


def _tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, int]]:
    """Nodes (feature, split, left, right, rows) of one isolation tree; a leaf is (-1, path length, 0, 0, rows)."""
    most, nodes = int(np.ceil(np.log2(max(len(x), 2)))), []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, depth + _expected(len(rows)), 0, 0, len(rows)))
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        free = np.flatnonzero(high > low)
        if depth >= most or len(rows) < 2 or not len(free):
            return at
        f = int(rng.choice(free))
        split = float(rng.uniform(low[f], high[f]))
        left = grow(rows[rows[:, f] < split], depth + 1)
        nodes[at] = (f, split, left, grow(rows[rows[:, f] >= split], depth + 1), len(rows))
        return at

    grow(x, 0)
    return nodes


def _expected(n: int) -> float:
    """Mean path length of a failed search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_forest(encoded: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> list[Tree]:
    """Isolation trees (Liu, Ting and Zhou, 2008); a leaf's value is its path length.

    Each tree grows in a task of its own from `sample` rows, as the method asks; rows are dealt to trees by hash. The forest has at most
    trees * 2 * sample nodes.
    """
    picked = encoded.select("features").orderBy(F.xxhash64("features", F.lit(seed)), "features").limit(trees * sample)
    dealt = picked.withColumn("tree", F.pmod(F.xxhash64("features", F.monotonically_increasing_id(), F.lit(seed + 1)), F.lit(trees)).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x, t = np.stack(pdf["features"].to_list()), int(pdf["tree"].iloc[0])
        x = x[np.lexsort(x.T[::-1])][:sample]
        return pd.DataFrame([(t, *node) for node in _tree(x, np.random.default_rng(seed + t))], columns=["tree", "feature", "split", "left", "right", "rows"])

    grown = dealt.groupBy("tree").applyInPandas(grow, "tree int, feature int, split double, left int, right int, rows int").toPandas()
    return [Tree(*(g[c].to_numpy() for c in ("feature", "split", "left", "right", "rows", "split")), strict=True) for _, g in grown.groupby("tree", sort=True)]


def isolation_scores(encoded: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42, forest: list[Tree] | None = None) -> DataFrame:
    """`encoded` with anomaly_score: 2 ** (-mean path / expected path); over 0.5 is anomalous. The forest is broadcast to score every row."""
    forest = isolation_forest(encoded, trees, sample, seed) if forest is None else forest
    shared = encoded.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            x = np.stack(rows.to_list()) if len(rows) else np.zeros((0, 1))
            total, base = sum(t.predict(x) for t in shared.value), sum(_expected(int(t.cover[0])) for t in shared.value)
            yield pd.Series(2.0 ** (-np.asarray(total) / base) if base else np.zeros(len(x)))

    return encoded.withColumn("anomaly_score", score("features"))


def explain_shape(sampled: DataFrame, columns: Sequence[str], period: str = "_period", exclude: Sequence[str] = (), anomalous: float = 0.5, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(feature, importance, mean) of the current rows (period 0) that the isolation forest flags: what each feature adds to their mean path; the most negative make them stand out."""
    encoded, names = encode(sampled, [c for c in columns if c not in exclude and c != period], [period])
    forest = isolation_forest(encoded, trees, sample, seed)
    flagged = isolation_scores(encoded, forest=forest).where((F.col(period) == 0) & (F.col("anomaly_score") > anomalous))
    return mean_contributions(attributions(flagged, explain(forest)), names)


def shape_check(sampled: DataFrame, columns: Sequence[str], period: str = "_period", exclude: Sequence[str] = (), warning: float = 0.6, error: float = 0.8, **options) -> DataFrame:
    """(total_current, anomaly_count, anomaly_ratio, severity): the share of current rows (period 0) that a forest over all periods flags."""
    cols = [c for c in columns if c not in exclude and c != period]
    encoded, _ = encode(sampled, cols, [period])
    scored = isolation_scores(encoded, **options).where(F.col(period) == 0)
    out = scored.agg(F.count(F.lit(1)).alias("total_current"), F.count_if(F.col("anomaly_score") > 0.5).alias("anomaly_count"))
    out = out.withColumn("anomaly_ratio", F.coalesce(F.try_divide("anomaly_count", "total_current"), F.lit(0.0)))
    r = F.col("anomaly_ratio")
    return out.withColumn("severity", F.when(F.col("total_current") == 0, 1).when(r >= error, 2).when(r >= warning, 1).otherwise(0))


def pattern_check(sampled: DataFrame, columns: Sequence[str], period: str = "_period", exclude: Sequence[str] = (), folds: int = 5, trees: int = 50, depth: int = 5, warning: float = 0.65, error: float = 0.8, seed: int = 42) -> dict:
    """Mean AUC of a random forest that tells current rows (period 0) from past ones, over folds dealt by hash, with severity and importances.

    `contributions` has the five features of greatest mean Shapley value by size, of a forest fitted to all rows, over all rows.

    Needs `folds` rows of each class; else the severity is a warning. An AUC over 0.95 with nothing excluded is marked as a likely leak.
    """
    cols = [c for c in columns if c not in exclude and c != period]
    encoded, names = encode(sampled, cols, [period])
    data = encoded.select((F.col(period) == 0).cast("double").alias("label"), "features", F.pmod(F.xxhash64("features", F.lit(seed)), F.lit(folds)).alias("fold")).withColumn("vector", array_to_vector("features")).persist()
    try:
        counts = {r[0]: r[1] for r in data.groupBy("label").count().collect()}
        if min(counts.get(0.0, 0), counts.get(1.0, 0)) < folds:
            return {"auc": None, "severity": 1, "importances": [], "contributions": [], "leak": False, "message": "too few rows"}
        forest = RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed)
        judge, aucs, weight = BinaryClassificationEvaluator(), [], np.zeros(len(names))
        for k in range(folds):
            model = forest.fit(data.where(F.col("fold") != k))
            aucs.append(judge.evaluate(model.transform(data.where(F.col("fold") == k))))
            weight += model.featureImportances.toArray()
        whole = explain(forest_trees(forest.fit(data), sampled.sparkSession))
        most = mean_contributions(attributions(data.select("features"), whole), names).orderBy(F.col("importance").desc(), "feature").limit(5).collect()
    finally:
        data.unpersist()
    auc = float(np.mean(aucs))
    top = sorted(zip(names, (weight / folds).tolist()), key=lambda x: -x[1])[:5]
    return {"auc": auc, "severity": 2 if auc >= error else int(auc >= warning), "importances": top, "contributions": [(r.feature, r.importance) for r in most], "leak": auc > 0.95 and not exclude, "message": ""}


def explain_drift(sampled: DataFrame, columns: Sequence[str], period: str = "_period") -> DataFrame:
    """(column_name, stat, past, current, delta_pct) of each column: period 0 against all others.

    Numbers: mean, std, quartiles, p99, min, max; booleans: true_rate; times: min and max as epoch seconds; all: null_pct. The change is
    NULL where the past is zero or missing. One aggregation.
    """
    kinds = {f.name: family(f.dataType.simpleString()) for f in sampled.schema}
    made: list[tuple[str, str, object]] = []
    for c in columns:
        x, kind = F.col(f"`{c}`"), kinds[c]
        made.append((c, "null_pct", F.count_if(x.isNull()) * 100.0 / F.count(F.lit(1))))
        if kind == "numeric":
            d = x.cast("double")
            made += [(c, "mean", F.avg(d)), (c, "std", F.stddev(d)), (c, "min", F.min(d)), (c, "max", F.max(d))]
            made += [(c, f"p{p}", F.percentile_approx(d, p / 100)) for p in (25, 50, 75, 99)]
        elif kind == "boolean":
            made.append((c, "true_rate", F.avg(x.cast("double"))))
        elif kind == "time":
            made += [(c, "min", F.unix_seconds(F.min(x).cast("timestamp"))), (c, "max", F.unix_seconds(F.max(x).cast("timestamp")))]
    wide = sampled.groupBy((F.col(period) == 0).alias("_now")).agg(*[e.cast("double").alias(f"s{i}") for i, (_, _, e) in enumerate(made)])
    rows = wide.select("_now", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("stat"), F.col(f"s{i}").alias("value")) for i, (c, s, _) in enumerate(made)])))
    out = rows.groupBy("column_name", "stat").agg(F.max(F.when(~F.col("_now"), F.col("value"))).alias("past"), F.max(F.when(F.col("_now"), F.col("value"))).alias("current"))
    return out.withColumn("delta_pct", F.try_divide((F.col("current") - F.col("past")) * 100, F.abs("past")))


def explain_slices(sampled: DataFrame, columns: Sequence[str], period: str = "_period") -> DataFrame:
    """(column_name, stat, slice, rows, value) of numeric and boolean columns by slice, 0 the current one: null_pct, mean (of booleans the true rate) and std. One aggregation."""
    kinds = {f.name: family(f.dataType.simpleString()) for f in sampled.schema}
    told = [c for c in columns if kinds[c] in ("numeric", "boolean")]
    stats = []
    for c in told:
        d = F.col(f"`{c}`").cast("double")
        stats += [(c, "null_pct", F.count_if(d.isNull()) * 100.0 / F.count(F.lit(1))), (c, "mean", F.avg(d)), (c, "std", F.stddev(d))]
    if not stats:
        return sampled.sparkSession.createDataFrame([], "column_name string, stat string, slice int, rows bigint, value double")
    wide = sampled.groupBy(F.col(period).cast("int").alias("slice")).agg(F.count(F.lit(1)).alias("rows"), *[x.alias(f"s{i}") for i, (_, _, x) in enumerate(stats)])
    one = lambda i, c, s: F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("stat"), F.col("slice"), F.col("rows"), F.col(f"s{i}").alias("value"))
    return wide.select(F.inline(F.array(*[one(i, c, s) for i, (c, s, _) in enumerate(stats)])))


def within_budget(explained: DataFrame, order: Sequence[str], most_bytes: int = 16_000) -> DataFrame:
    """(column_name, details_json, truncated): what is told of each column as JSON, most important column first, as long as all of it has at most `most_bytes`.

    `explained` has column_name, stat and whatever is told of them; `order` lists the columns. A column that does not fit, and all after
    it, have no details. There is a row a column, so that one task can add the sizes up.
    """
    rest = [c for c in explained.columns if c != "column_name"]
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("column_name"))
    told = explained.groupBy("column_name").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("details_json")).withColumn("_at", place).where("_at > 0")
    so_far = F.sum(F.octet_length("details_json")).over(Window.orderBy("_at"))
    fits = F.col("_so_far") <= most_bytes
    return told.withColumn("_so_far", so_far).select("column_name", F.when(fits, F.col("details_json")).alias("details_json"), (~fits).alias("truncated"))


def explain_labels(sampled: DataFrame, column: str, period: str = "_period", top: int = 5) -> DataFrame:
    """(value, past_rate, current_rate) of the most frequent values of either side, at most twice `top`, by current then past rate."""
    x = F.col(f"`{column}`").cast("string").alias("value")
    n = sampled.groupBy(x, (F.col(period) == 0).alias("now")).agg(F.count(F.lit(1)).alias("n"))
    side = n.groupBy("now").agg(F.sum("n").alias("total"))
    rates = n.join(F.broadcast(side), "now").withColumn("rate", F.col("n") / F.col("total"))
    ranked = rates.withColumn("r", F.row_number().over(Window.partitionBy("now").orderBy(F.col("rate").desc(), "value")))
    both = ranked.groupBy("value").agg(F.min("r").alias("r"), *[F.coalesce(F.max(F.when(F.col("now") == flag, F.col("rate"))), F.lit(0.0)).alias(name) for flag, name in ((False, "past_rate"), (True, "current_rate"))])
    return both.where(F.col("r") <= top).drop("r").orderBy(F.col("current_rate").desc(), F.col("past_rate").desc(), "value")


def features_pipeline(categorical: Sequence[str], numeric: Sequence[str], scaled: bool = False) -> list:
    """Stages that index and one-hot texts and assemble them with the numbers as `features`."""
    stages = [s for c in categorical for s in (StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_vec"))]
    stages.append(VectorAssembler(inputCols=[*[f"{c}_vec" for c in categorical], *numeric], outputCol="raw" if scaled else "features", handleInvalid="keep"))
    return stages + ([StandardScaler(inputCol="raw", outputCol="features")] if scaled else [])


def train_classifier(train: DataFrame, label: str, categorical: Sequence[str], numeric: Sequence[str], trees: int = 50, seed: int = 42, layers: Sequence[int] | None = None):
    """A fitted pipeline ending in a random forest, or in a neural net with these hidden layers (numeric features alone)."""
    if layers:
        net = MultilayerPerceptronClassifier(labelCol=label, layers=[len(numeric), *layers, 2], seed=seed, maxIter=60)
        return Pipeline(stages=[*features_pipeline([], numeric, True), net]).fit(train)
    return Pipeline(stages=[*features_pipeline(categorical, numeric), RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed)]).fit(train)


def train_regressor(train: DataFrame, label: str, categorical: Sequence[str], numeric: Sequence[str], trees: int = 50, seed: int = 42):
    return Pipeline(stages=[*features_pipeline(categorical, numeric), RandomForestRegressor(labelCol=label, numTrees=trees, seed=seed)]).fit(train)


def evaluate(predicted: DataFrame, label: str, regression: bool = False) -> dict[str, float]:
    """auc, accuracy and f1 of a classifier, rmse and r2 of a regressor."""
    if regression:
        return {m: RegressionEvaluator(labelCol=label, metricName=m).evaluate(predicted) for m in ("rmse", "r2")}
    out = {m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(predicted) for m in ("accuracy", "f1")}
    return out | {"auc": BinaryClassificationEvaluator(labelCol=label).evaluate(predicted)}


#: A task compares so many users at most with so many items at most; a group of users that is not halved any more meets a box of items at once.
USER_ROWS, ITEM_ROWS, _BOX, _GROUP = 1 << 17, 1 << 18, 8192, 64


def unrated_search(box: int, near_users: int):
    """The function `best_unrated`, of inner functions alone: tasks get it whole and need not import this package."""
    tried, most_users = 32, 8192  # items that raise a group's bars before it is halved, and the users of the largest group that gets bars

    def search(users: np.ndarray, items: np.ndarray, ids: np.ndarray, at: np.ndarray, rated: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of users, item id, score) of the n best items of each user, ties to smaller ids, without the pairs (at, rated) of a user's row and an id.

        Exact: users of like directions are halved again and again, and each half drops the items that none of its users can want: the score
        by its mean direction, and what its users are off that at most, stay under the bars, which are each user's n-th best score so far.
        """
        by_id = np.argsort(ids)
        by_user = np.argsort(at, kind="stable")
        gone = by_id[np.searchsorted(ids, rated, sorter=by_id)][by_user] if len(rated) else np.empty(0, np.int64)
        ends = np.searchsorted(at[by_user], np.arange(len(users) + 1))
        size = np.linalg.norm(users, axis=1)
        unit = users / np.where(size > 0, size, 1)[:, None]
        middle = items.mean(axis=0)
        away, lead = items - middle, unit @ middle
        off = np.linalg.norm(away, axis=1) * (1 + 1e-9) + 1e-9 * np.abs(items).max()
        bars, place, out = np.full(len(users), -np.inf), np.full(len(ids), -1), []

        def scores(rows: np.ndarray, some: np.ndarray, gone_at: np.ndarray, gone_of: np.ndarray) -> np.ndarray:
            got = (users[rows] @ items[some].T).astype(np.float32)
            place[some] = np.arange(len(some))
            to = place[gone_of]
            got[gone_at[to >= 0], to[to >= 0]] = -np.inf
            place[some] = -1
            return got

        def settle(rows: np.ndarray, left: np.ndarray, gone_at: np.ndarray, gone_of: np.ndarray) -> None:
            who, what, score, least = np.empty(0, np.int64), np.empty(0, ids.dtype), np.empty(0, np.float32), bars[rows]
            for start in range(0, len(left), box):
                some = left[start : start + box]
                got = scores(rows, some, gone_at, gone_of)
                keep = min(n, len(some))
                x, y = np.nonzero((got >= np.maximum(np.partition(got, -keep, axis=1)[:, -keep], least)[:, None]) & (got > -np.inf))
                who, what, score = np.concatenate([who, x]), np.concatenate([what, ids[some[y]]]), np.concatenate([score, got[x, y]])
                sort = np.lexsort((what, -score, who))
                who, what, score = who[sort], what[sort], score[sort]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                who, what, score, rank = (z[rank < n] for z in (who, what, score, rank))
                full = rank == n - 1
                least[who[full]] = np.maximum(least[who[full]], score[full])
            out.append((rows[who], what, score))

        still = np.flatnonzero(size == 0)  # all their scores are 0: the smallest ids that they have not rated
        every = np.arange(len(ids))
        todo = [(np.flatnonzero(size > 0), every, away, off)]
        if len(still):
            first = by_id[: n + int(np.diff(ends)[still].max())]
            todo += [(still[k : k + near_users], first, away[first], off[first]) for k in range(0, len(still), near_users)]
        while todo:
            rows, left, of, reach = todo.pop()
            if not len(rows):
                continue
            u, ended = unit[rows], size[rows[0]] == 0
            if len(rows) <= max(most_users, near_users):
                many = ends[rows + 1] - ends[rows]
                gone_at = np.repeat(np.arange(len(rows)), many)
                gone_of = gone[np.arange(many.sum()) + np.repeat(ends[rows] - (np.cumsum(many) - many), many)]
                if not ended:
                    mean = u.mean(axis=0)
                    wide = np.sqrt(((u - mean) ** 2).sum(axis=1).max())
                    by_mean = of @ mean
                    if n <= tried < len(left):
                        got = scores(rows, left[np.argpartition(by_mean, -tried)[-tried:]], gone_at, gone_of)
                        bars[rows] = np.maximum(bars[rows], np.partition(got, -n, axis=1)[:, -n])
                    bar = bars[rows] / size[rows]
                    may = by_mean + wide * reach + (lead[rows] - bar + 1e-6 * np.abs(bar)).max() + 1e-9 * reach >= 0
                    if (kept := np.count_nonzero(may)) < 0.75 * len(left):
                        left, of, reach = left[may], of[may], reach[may]
                    ended = len(rows) <= near_users or len(rows) * kept <= near_users * near_users
                    if ended and len(left) > kept:
                        left = left[may]
                if ended:
                    settle(rows, left, gone_at, gone_of)
                    continue
            half = np.argpartition(u[:, np.ptp(u, axis=0).argmax()], len(rows) // 2)
            todo += [(rows[half[: len(rows) // 2]], left, of, reach), (rows[half[len(rows) // 2 :]], left, of, reach)]
        return tuple(np.concatenate(z) for z in zip(*out))

    return search


def best_unrated(*args):
    """As `search` of unrated_search: (users, items, ids, at, rated, n)."""
    return unrated_search(_BOX, _GROUP)(*args)


def recommend(ratings: DataFrame, user: str, item: str, rating: str, n: int = 5, rank: int = 8, seed: int = 42) -> tuple[DataFrame, float]:
    """(user, item, score, rank) of the n best items that each user has not rated, and the RMSE over the ratings.

    Users go by blocks and items by parts, of bounded size; each block meets each part in one task, which passes by what cannot be among
    a user's best and gives n rows a user. A user's rated items go only to the parts they are in. The ratings are kept while the model is
    fitted and its error told.
    """
    level = ratings.storageLevel
    if kept := not (level.useMemory or level.useDisk):
        ratings.persist()
    try:
        model = ALS(userCol=user, itemCol=item, ratingCol=rating, rank=rank, seed=seed, coldStartStrategy="drop", nonnegative=True).fit(ratings)
        error = RegressionEvaluator(labelCol=rating, predictionCol="prediction", metricName="rmse").evaluate(model.transform(ratings))
    finally:
        if kept:
            ratings.unpersist()
    n_users, n_items = model.userFactors.count(), model.itemFactors.count()
    parts = max(1, -(-n_items // ITEM_ROWS))
    blocks = max(1, -(-n_users // USER_ROWS), min(ratings.sparkSession.sparkContext.defaultParallelism, n_users // 4096))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rated = ratings.groupBy(F.col(user).cast("int").alias("id"), deal(F.col(item).cast("int"), parts).alias("part")).agg(F.collect_set(F.col(item).cast("int")).alias("rated"))
    users = model.userFactors.withColumn("block", deal("id", blocks)).withColumn("part", every(parts)).join(rated, ["id", "part"], "left")
    items = model.itemFactors.withColumn("part", deal("id", parts)).withColumn("block", every(blocks))

    search = unrated_search(_BOX, _GROUP)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = [t.column("id").to_numpy() for t in (left, right)]
        u, v = (np.asarray(t.column("features").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (left, right))
        lists = left.column("rated").combine_chunks()
        if left.num_rows and right.num_rows:
            at = np.repeat(np.arange(left.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            who, what, score = search(u, v, ids[1], at, np.asarray(lists.flatten()), n)
        else:
            who, what, score = np.empty(0, np.int64), ids[1][:0], np.empty(0)
        return pa.table({user: pa.array(ids[0][who], pa.int32()), item: pa.array(what, pa.int32()), "score": pa.array(score, pa.float64())})

    listed = users.groupBy("block", "part").cogroup(items.groupBy("block", "part")).applyInArrow(best, f"`{user}` int, `{item}` int, score double")
    return listed.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.col("score").desc(), item))).where(F.col("rank") <= n), error


def mixed_effects(df: DataFrame, y: str, x: str, group: str, rounds: int = 50) -> dict[str, float]:
    """Random-intercept model y = a + b x + u(group) + e by EM over sums by group, which are all that each round reads.

    Returns a, b and the two variances. The groups' sums are aggregated by Spark; the rounds are five sums over them, kept on the executors.
    """
    c = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("g is not null and x is not null and y is not null")
    sums = c.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy")).persist()
    try:
        t = sums.agg(*[F.sum(k) for k in ("n", "sx", "sy", "sxx", "sxy", "syy")], F.count(F.lit(1))).first()
        n, groups = t[0], t[6]
        b = (n * t[4] - t[1] * t[2]) / (n * t[3] - t[1] ** 2)
        a = (t[2] - b * t[1]) / n
        vu = ve = max((t[5] - a * t[2] - b * t[4]) / n / 2, 1e-12)
        for _ in range(rounds):
            u = F.lit(vu) * (F.col("sy") - a * F.col("n") - b * F.col("sx")) / (F.lit(vu) * F.col("n") + ve)
            v = F.lit(vu * ve) / (F.lit(vu) * F.col("n") + ve)
            r = sums.select("*", u.alias("u"), v.alias("v")).agg(F.sum(F.col("u") * F.col("n")), F.sum(F.col("u") * F.col("sx")), F.sum(F.col("u") * F.col("sy")), F.sum(F.col("n") * F.col("u") ** 2), F.sum(F.col("u") ** 2 + F.col("v")), F.sum(F.col("n") * F.col("v"))).first()
            sy, sxy = t[2] - r[0], t[4] - r[1]
            b = (n * sxy - t[1] * sy) / (n * t[3] - t[1] ** 2)
            a = (sy - b * t[1]) / n
            square = t[5] - 2 * a * t[2] - 2 * b * t[4] - 2 * r[2] + n * a * a + 2 * a * b * t[1] + b * b * t[3] + 2 * a * r[0] + 2 * b * r[1] + r[3]
            vu, ve = max(r[4] / groups, 1e-12), max((square + r[5]) / n, 1e-12)
    finally:
        sums.unpersist()
    return {"intercept": a, "slope": b, "group_variance": vu, "residual_variance": ve}
