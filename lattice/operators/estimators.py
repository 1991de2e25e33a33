"""The algorithm registry and its estimators.

Each takes a table with numeric feature columns and `label`, and gives a model whose transform(df) adds
`prediction` (and, where it has them, `probability`, an array in the order of `classes`). Tree ensembles, linear
models, k-means and mixtures are the engine's own; the rest are aggregations or passes over Arrow batches here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import softmax
from ..session import map_arrow, materialise, ship
from . import linalg, reach
from .graph import components
from .matrix import Matrix, numbers
from .metrics import class_order

ROWS = "row_idx"


@dataclass(frozen=True)
class Param:
    kind: str
    default: Any
    low: float | None = None
    high: float | None = None
    options: tuple = ()

    def check(self, name: str, value: Any) -> Any:
        """The value, typed; ValueError outside the range or options."""
        if value is None:
            return self.default
        value = {"int": int, "float": float, "bool": bool, "choice": str, "list": lambda x: x}[self.kind](value)
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{name}={value} is outside {self.low}..{self.high}")
        if self.options and value not in self.options:
            raise ValueError(f"{name}={value} is none of {self.options}")
        return value


def vector(df: DataFrame, features: list[str], name: str = "_v") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(f"`{c}`").cast("double") for c in features]))


class Model:
    """classes is None for regressors and clusterers."""

    classes: list[str] | None = None
    importances: dict[str, float] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class Estimator:
    params: dict[str, Any] = field(default_factory=dict)
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Model:
        raise NotImplementedError


def class_names(df: DataFrame, label: str) -> list[str]:
    return [r.c for r in df.select(F.col(label).cast("string").alias("c")).distinct().orderBy(*class_order("c")).collect()]


# -- the engine's own


class SparkModel(Model):
    def __init__(self, stages: list, features: list[str], classes: list[str] | None, importances: dict[str, float] | None):
        self.stages, self.features, self.classes, self.importances = stages, features, classes, importances

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        names = df.columns
        out = vector(df, self.features).withColumn("_features", array_to_vector("_v"))
        for s in self.stages:
            out = s.transform(out)
        made = F.col("_prediction")
        if self.classes is not None:
            made = F.get(F.array(*[F.lit(c) for c in self.classes]), made.cast("int"))
        extra = [vector_to_array("_probability").alias("probability")] if "_probability" in out.columns else []
        return out.select(*[F.col(f"`{c}`") for c in names], made.alias("prediction"), *extra)


class Engine(Estimator):
    """make(params, seed, n) -> an estimator of pyspark.ml; kind: classification, regression or clustering."""

    def __init__(self, make, kind: str, params: dict[str, Any], seed: int = 0):
        super().__init__(params, seed)
        self.make, self.kind = make, kind

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Model:
        from pyspark.ml.functions import array_to_vector

        classes = class_names(df, label) if self.kind == "classification" else None
        data = vector(df, features).withColumn("_features", array_to_vector("_v"))
        n = data.count()
        if classes is not None:
            data = data.withColumn("_label", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1).cast("double"))
        elif self.kind == "regression":
            data = data.withColumn("_label", F.col(label).cast("double"))
        est = self.make(self.params, self.seed, {"n": n, "classes": len(classes or []), "spread": data.agg(F.stddev_pop("_label")).first()[0] if self.kind == "regression" else None})
        model = est.fit(data)
        importances = None
        found = getattr(model, "featureImportances", None)
        if found is None and self.kind != "clustering" and getattr(model, "numClasses", 2) == 2:
            found = getattr(model, "coefficients", None)
        if found is not None:
            importances = {c: float(x) for c, x in zip(features, found.toArray(), strict=True)}
        return SparkModel([model], features, classes, importances)


def _columns(**more: Any) -> dict:
    return {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction", **more}


def _random_forest(p, seed, about):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(**_columns(probabilityCol="_probability", rawPredictionCol="_raw"), numTrees=p["estimators"], subsamplingRate=p["ratio"], maxDepth=p["max_depth"], minInstancesPerNode=p["min_samples"], seed=seed)


def _tree(p, seed, about):
    from pyspark.ml.classification import DecisionTreeClassifier

    return DecisionTreeClassifier(**_columns(probabilityCol="_probability", rawPredictionCol="_raw"), maxDepth=p["max_depth"], minInstancesPerNode=p["min_samples"], seed=seed)


def _regression_tree(p, seed, about):
    from pyspark.ml.regression import DecisionTreeRegressor

    return DecisionTreeRegressor(**_columns(), maxDepth=p["max_depth"], seed=seed)


def _boost(p, seed, about):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    one = GBTClassifier(**_columns(), maxIter=p["estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], subsamplingRate=p["ratio"], seed=seed)
    if about["classes"] <= 2:
        return one.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    return OneVsRest(classifier=GBTClassifier(maxIter=p["estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], subsamplingRate=p["ratio"], seed=seed), **_columns())


def _boost_regressor(p, seed, about):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(**_columns(), maxIter=p["estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], seed=seed)


def _logistic(p, seed, about):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(**_columns(probabilityCol="_probability", rawPredictionCol="_raw"), regParam=p["l2"], elasticNetParam=0.0, maxIter=p["epochs"])


def _lasso(p, seed, about):
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(**_columns(), elasticNetParam=1.0, regParam=p["alpha"], standardization=False)


def _kmeans(p, seed, about):
    from pyspark.ml.clustering import KMeans

    return KMeans(featuresCol="_features", predictionCol="_prediction", k=p["k"], maxIter=p["epochs"], tol=p["min_change"], seed=seed)


def _mixture(p, seed, about):
    from pyspark.ml.clustering import GaussianMixture

    return GaussianMixture(featuresCol="_features", predictionCol="_prediction", probabilityCol="_probability", k=p["k"], maxIter=p["epochs"], seed=seed)


class SupportVectors(Estimator):
    """Linear machines, one class against the rest; rbf and poly through an explicit map of the features."""

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Model:
        from pyspark.ml.classification import LinearSVC, OneVsRest

        kernel, c = self.params["kernel"], self.params["c"]
        mapped = _FeatureMap(kernel, features, self.seed).fit(df)
        reg = lambda n: 1.0 / (c * max(n, 1))
        one = Engine(lambda p, s, about: OneVsRest(classifier=LinearSVC(regParam=reg(about["n"]), maxIter=30), **_columns(), parallelism=4), "classification", self.params, self.seed)
        model = one.fit(mapped.transform(df), mapped.names, label)
        return _Mapped(mapped, model)


class _FeatureMap:
    """linear: scaled features; poly: with squares and products; rbf: random Fourier features of them."""

    def __init__(self, kernel: str, features: list[str], seed: int, size: int = 128):
        self.kernel, self.features, self.seed, self.size = kernel, features, seed, size

    def fit(self, df: DataFrame) -> _FeatureMap:
        row = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(self.features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.shift = [(row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i in range(len(self.features))]
        d = len(self.features)
        if self.kernel == "rbf":
            rng = np.random.default_rng(self.seed)
            self.weights, self.phase = rng.normal(0, (1.0 / d) ** 0.5, (self.size, d)), rng.uniform(0, 2 * np.pi, self.size)
            self.names = [f"_f{k}" for k in range(self.size)]
        elif self.kernel == "poly":
            self.names = [f"_f{k}" for k in range(d + d * (d + 1) // 2)]
        else:
            self.names = [f"_f{k}" for k in range(d)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        x = [(F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in zip(self.features, self.shift, strict=True)]
        df = df.withColumn("_x", F.array(*x))
        at = lambda i: F.get("_x", F.lit(i))
        if self.kernel == "rbf":
            dot = lambda w: F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(a)) for a in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            made = [F.cos(dot(w) + F.lit(float(p))) * F.lit((2.0 / self.size) ** 0.5) for w, p in zip(self.weights, self.phase, strict=True)]
        else:
            made = [at(i) for i in range(len(x))]
            if self.kernel == "poly":
                made += [at(i) * at(j) for i in range(len(x)) for j in range(i, len(x))]
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c != "_x"], *[m.alias(n) for m, n in zip(made, self.names, strict=True)])


    def to_dict(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}

    @classmethod
    def from_dict(cls, held: dict) -> _FeatureMap:
        """Arrays may be lists: they are read row by row."""
        out = cls(held["kernel"], held["features"], held["seed"], held["size"])
        vars(out).update(held)
        return out


class _Mapped(Model):
    def __init__(self, mapped: _FeatureMap, model: Model):
        self.mapped, self.model, self.classes = mapped, model, model.classes

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.mapped.transform(df)).drop(*self.mapped.names)


# -- nearest neighbours

#: Bytes of training rows that a task holds at once.
KNN_BLOCK = 64 << 20


def nearest(queries: DataFrame, train: DataFrame, k: int, key: str = ROWS) -> DataFrame:
    """(key, d, t): the k training rows (t, v) nearest to each query (key, v), ties by smaller t.

    Training rows are dealt into blocks of bounded size; every query meets every block, keeps the block's k
    nearest, and the k best of those are merged by key.
    """
    size = train.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    blocks = max(1, -(-size.n * size.d * 8 // KNN_BLOCK))
    dealt = train.select(F.pmod(F.xxhash64("t"), F.lit(blocks)).alias("b"), F.lit(True).alias("is_train"), F.col("t").alias("id"), "v")
    if blocks == 1:
        rows = train.orderBy("t").collect()  # at most KNN_BLOCK bytes
        sent = queries.sparkSession.sparkContext.broadcast((np.array([r.t for r in rows]), np.array([r.v for r in rows], float)))

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, v = sent.value
            for batch in batches:
                yield _nearest_batch(batch.column(0).to_numpy(zero_copy_only=False), numbers(batch.column(1)), ids, v, k)

        return map_arrow(queries.select(F.col(key).cast("long").alias("key"), "v"), one, "key long, d double, t long")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.lit(False).alias("is_train"), F.col(key).cast("long").alias("id"), "v")

    def block(group: pa.Table) -> pa.Table:
        is_train = group.column("is_train").to_numpy(zero_copy_only=False)
        ids, v = group.column("id").to_numpy(), numbers(group.column("v").combine_chunks())
        order = np.argsort(ids[is_train], kind="stable")
        return pa.Table.from_batches([_nearest_batch(ids[~is_train], v[~is_train], ids[is_train][order], v[is_train][order], k)])

    # Queries are salted, so that a group holds one block and a bounded share of the queries.
    salts = max(1, -(-queries.count() * size.d * 8 // KNN_BLOCK))
    asked = asked.withColumn("s", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(salts)))
    dealt = dealt.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    ship(queries.sparkSession)
    near = dealt.unionByName(asked).groupBy("b", "s").applyInArrow(block, "key long, d double, t long")
    merged = near.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "t"))), 1, k).alias("n"))  # k a block
    return merged.select("key", F.explode("n").alias("n")).select("key", "n.d", "n.t")


#: Distances that a task holds at once.
KNN_CELLS = 2_000_000


def _nearest_batch(keys: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest by sums of squared differences; products with a bound of their error only rule rows out."""
    out_key, out_d, out_t = [], [], []
    step = max(1, min(256, KNN_CELLS // max(len(v), 1)))
    norms = (v**2).sum(axis=-1)
    for a in range(0, len(keys) if len(v) else 0, step):
        part = q[a : a + step]
        both = (part**2).sum(axis=-1)[:, None] + norms[None, :]
        error = 8 * (part.shape[-1] + 8) * np.finfo(float).eps * both
        about = both - 2 * part @ v.T
        bound = np.partition(about + error, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
        near = ~(about - error > bound[:, None])  # what isn't a number stays
        for key, x, row in zip(keys[a : a + step], part, near, strict=True):
            at = np.flatnonzero(row)
            d = np.sqrt(((x - v[at]) ** 2).sum(axis=1))
            best = np.argsort(d, kind="stable")[:k]  # ids rise, so ties go to the smaller
            out_key.append(np.repeat(key, len(best)))
            out_d.append(d[best])
            out_t.append(ids[at[best]])
    join = lambda xs, t: pa.array(np.concatenate(xs) if xs else [], t)
    return pa.RecordBatch.from_arrays([join(out_key, pa.int64()), join(out_d, pa.float64()), join(out_t, pa.int64())], ["key", "d", "t"])


class Neighbours(Estimator):
    """k nearest neighbours: a (weighted) vote, or a mean. Rows are told apart by row_idx."""

    regression = False

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Model:
        train = vector(df, features).select(F.col(ROWS).alias("t"), F.col("_v").alias("v"), F.col(label).cast("double" if self.regression else "string").alias("y"))
        return _NeighbourModel(train, features, self.params["k"], bool(self.params.get("weighted")), self.regression, None if self.regression else class_names(df, label))


class NeighbourRegressor(Neighbours):
    regression = True


class _NeighbourModel(Model):
    def __init__(self, train: DataFrame, features: list[str], k: int, weighted: bool, regression: bool, classes: list[str] | None):
        self.train, self.features, self.k, self.weighted, self.regression, self.classes = train, features, k, weighted, regression, classes

    def transform(self, df: DataFrame) -> DataFrame:
        found = nearest(vector(df, self.features).withColumnRenamed("_v", "v"), self.train.select("t", "v"), self.k)
        voted = found.join(self.train.select("t", "y"), "t")
        weight = F.lit(1.0) / (F.lit(1.0) + F.col("d")) if self.weighted else F.lit(1.0)
        if self.regression:
            made = voted.groupBy("key").agg((F.sum(F.col("y") * weight) / F.sum(weight)).alias("prediction"))
        else:
            votes = voted.groupBy("key", "y").agg(F.sum(weight).alias("w"))
            made = votes.groupBy("key").agg(F.max(F.struct(F.round("w", 9).alias("w"), _reversed("y", self.classes).alias("o"), F.col("y").alias("y")))["y"].alias("prediction"), F.map_from_entries(F.collect_list(F.struct("y", "w"))).alias("_m"), F.sum("w").alias("_s"))
            share = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(c)), F.lit(0.0)) / F.col("_s") for c in self.classes or []])
            made = made.select("key", "prediction", share.alias("probability"))
        return df.join(made, df[ROWS] == made["key"], "left").drop("key")


def _reversed(name: str, classes: list[str] | None) -> Column:
    """Larger for classes earlier in order, so that ties go to the first."""
    return -F.array_position(F.array(*[F.lit(c) for c in classes or []]), F.col(name))


# -- naive Bayes


class GaussianBayes(Estimator):
    """Class means and population variances from one aggregation; priors from the data unless given."""

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Model:
        aggs = [f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("v", F.var_pop))]
        rows = {r.c: r for r in df.groupBy(F.col(label).cast("string").alias("c")).agg(F.count("*").alias("n"), *aggs).collect()}
        classes = class_names(df, label)
        n = sum(r.n for r in rows.values())
        given = self.params.get("priors") or {}
        table = [(float(given.get(c, rows[c].n / n)), [rows[c][f"m{i}"] for i in range(len(features))], [max(rows[c][f"v{i}"], 1e-9) for i in range(len(features))]) for c in classes]
        return _BayesModel(classes, features, table)


class _BayesModel(Model):
    def __init__(self, classes: list[str], features: list[str], table: list):
        self.classes, self.features, self.table = classes, features, table

    def transform(self, df: DataFrame) -> DataFrame:
        def likelihood(prior: float, means: list[float], variances: list[float]) -> Column:
            const = np.log(prior) - 0.5 * sum(np.log(2 * np.pi * v) for v in variances)
            terms = F.zip_with("_v", F.array(*[F.struct(F.lit(m).alias("m"), F.lit(v).alias("v")) for m, v in zip(means, variances, strict=True)]), lambda x, p: (x - p["m"]) * (x - p["m"]) / p["v"])
            return F.lit(float(const)) - F.lit(0.5) * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

        out = vector(df, self.features).withColumn("_l", F.array(*[likelihood(*row) for row in self.table]))
        top = F.array_max("_l")
        made = F.get(F.array(*[F.lit(c) for c in self.classes]), (F.array_position("_l", top) - 1).cast("int"))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], made.alias("prediction"), softmax(F.col("_l")).alias("probability"))


# -- linear regression


class Ridge(Estimator):
    """Closed form from one pass: (X'X + alpha I) w = X'y on centred columns, so the intercept is free."""

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Model:
        v = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in features], F.col(label).cast("double"))
        g = Matrix(df.select(F.lit(0).cast("long").alias("row_id"), v.alias("v")), n=len(features) + 2).gram().local()
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        centred = g[1:, 1:] - n * np.outer(mean, mean)
        d = len(features)
        w = linalg.solve(centred[:d, :d] + self.params["alpha"] * np.eye(d), centred[:d, d])
        return LinearModel(features, w.tolist(), float(mean[d] - w @ mean[:d]))


class LinearModel(Model):
    def __init__(self, features: list[str], weights: list[float], intercept: float):
        self.features, self.weights, self.intercept = features, weights, intercept
        self.importances = dict(zip(features, map(abs, weights), strict=True))

    def transform(self, df: DataFrame) -> DataFrame:
        made = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights, strict=True):
            made = made + F.col(f"`{c}`").cast("double") * F.lit(w)
        return df.withColumn("prediction", made)


class SupportVectorRegressor(Estimator):
    """Linear, epsilon-insensitive: full-batch subgradient steps on scaled columns, each task summing its rows' part."""

    STEPS = 60

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Model:
        names = [*features, label]
        row = df.agg(F.count("*").alias("n"), *[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        mean, spread = np.array([row[f"m{i}"] for i in range(len(names))]), np.array([row[f"s{i}"] or 1.0 for i in range(len(names))])
        data = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("v")).persist()
        c, eps, n = self.params["c"], self.params["epsilon"], max(row.n, 1)
        w, average = np.zeros(len(names)), np.zeros(len(names))
        for step in range(self.STEPS):
            sent = data.sparkSession.sparkContext.broadcast(w)

            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(len(mean))
                for batch in batches:
                    if batch.num_rows:
                        z = (numbers(batch.column(0)) - mean) / spread
                        x = np.hstack([z[:, :-1], np.ones((len(z), 1))])
                        left = x @ sent.value - z[:, -1]
                        total += x.T @ (np.sign(left) * (np.abs(left) > eps))
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

            parts = map_arrow(data, part, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
            g = np.zeros(len(names))
            for r in parts:
                g[r.i] = r.x
            w = w - (1.0 / (1 + step) ** 0.6) * (g / n + np.append(w[:-1], 0) / (c * n))
            average = average + (w - average) * (2.0 / (step + 2))
            sent.unpersist()
        data.unpersist()
        weights = average[:-1] * spread[-1] / spread[:-1]
        return LinearModel(features, weights.tolist(), float(mean[-1] + average[-1] * spread[-1] - weights @ mean[:-1]))


# -- boosting by reweighting


class AdaBoost(Estimator):
    """SAMME over stumps: rows carry weights; each round's error is one aggregation."""

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Model:
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.functions import array_to_vector

        classes = class_names(df, label)
        k, rate = len(classes), self.params["learning_rate"]
        base = vector(df, features).select(array_to_vector("_v").alias("_features"), (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1).cast("double").alias("_label")).persist()
        found: list[tuple[float, Any]] = []
        for _ in range(self.params["estimators"]):
            data = base.withColumn("_w", self._weight(found))
            model = DecisionTreeClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction", weightCol="_w", maxDepth=1, seed=self.seed).fit(data)
            wrong = F.col("_prediction") != F.col("_label")
            row = model.transform(data).agg(F.sum(F.when(wrong, F.col("_w")).otherwise(0.0)).alias("e"), F.sum("_w").alias("s")).first()
            error = row.e / row.s if row.s else 0.0
            if error >= 1 - 1 / k:
                break
            found.append((rate * float(np.log(max(1 - error, 1e-10) / max(error, 1e-10)) + np.log(max(k - 1, 1))), _Stump.of(model, k)))
            if error < 1e-10:
                break
        base.unpersist()
        return _BoostModel(found, features, classes)

    @staticmethod
    def _weight(found: list) -> Column:
        """A row's weight follows from the stumps so far, so nothing is carried from round to round."""
        from pyspark.ml.functions import vector_to_array

        total = F.lit(0.0)
        for alpha, stump in found:
            total = total + F.when(stump.predict(vector_to_array("_features")) != F.col("_label").cast("int"), F.lit(alpha)).otherwise(0.0)
        return F.exp(F.least(total, F.lit(300.0)))


@dataclass
class _Stump:
    feature: int
    threshold: float
    left: int
    right: int

    @classmethod
    def of(cls, model, k: int) -> _Stump:
        node = model._java_obj.rootNode() if hasattr(model, "_java_obj") else model._call_java("rootNode")
        if node.numDescendants() == 0:
            at = int(node.prediction())
            return cls(0, float("inf"), at, at)
        return cls(int(node.split().featureIndex()), float(node.split().threshold()), int(node.leftChild().prediction()), int(node.rightChild().prediction()))

    def predict(self, v: Column) -> Column:
        return F.when(F.get(v, F.lit(self.feature)) <= F.lit(self.threshold), self.left).otherwise(self.right)


class _BoostModel(Model):
    def __init__(self, found: list, features: list[str], classes: list[str]):
        self.found, self.features, self.classes = found, features, classes

    def transform(self, df: DataFrame) -> DataFrame:
        out = vector(df, self.features)
        votes = []
        for k in range(len(self.classes)):
            v = F.lit(0.0)
            for alpha, stump in self.found:
                v = v + F.when(stump.predict(F.col("_v")) == k, F.lit(alpha)).otherwise(0.0)
            votes.append(v)
        out = out.withColumn("_s", F.array(*votes))
        made = F.get(F.array(*[F.lit(c) for c in self.classes]), (F.array_position("_s", F.array_max("_s")) - 1).cast("int"))
        share = F.transform("_s", lambda s: s / F.lit(sum(alpha for alpha, _ in self.found) or 1.0))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], made.alias("prediction"), share.alias("probability"))


# -- density clusters


class Dbscan(Estimator):
    """Rows within the radius of min_samples rows (themselves included) are cores; cores in reach form a cluster.

    Clusters are numbered by their smallest row_idx. Any other row, of the training table or not, belongs to the
    first cluster with a core in its reach, or to none (-1).
    """

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Model:
        from pyspark.sql import Window

        radius, width = self.params["radius"], len(features)
        rows = materialise(vector(df, features).select(F.col(ROWS).cast("long").alias("id"), F.col("_v").alias("v")))
        core = materialise(rows.join(reach.dense(reach.pack(rows, radius, width), radius, self.params["min_samples"]), "id"))
        labels = connected(reach.links(reach.pack(core, radius, width), radius))
        # A row for each cluster.
        names = labels.select("component").distinct().select("component", (F.row_number().over(Window.orderBy("component")) - 1).alias("prediction"))
        return _DbscanModel(materialise(core.join(labels.join(names, "component"), "id").select(F.col("v").alias("v2"), "prediction").distinct()), features, radius)


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id in reach of every node of (u, v); a node linked with itself only is its own."""
    edges = materialise(edges)
    nodes = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    return materialise(nodes.join(components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component")))


class _DbscanModel(Model):
    """cores: (v2, prediction) of the core rows, equal ones once."""

    def __init__(self, cores: DataFrame, features: list[str], radius: float):
        self.cores, self.features, self.radius = cores, features, radius

    def transform(self, df: DataFrame) -> DataFrame:
        rows, width = vector(df, self.features), len(self.features)
        asked = materialise(rows.select(F.xxhash64("_v").alias("id"), F.col("_v").alias("v")).distinct())  # equal rows are looked up once
        cores = reach.pack(self.cores.select(F.col("prediction").alias("id"), F.col("v2").alias("v")), self.radius, width)
        found = reach.smallest(reach.pack(asked, self.radius, width), cores, self.radius).select(F.col("v").alias("_w"), F.col("least").alias("_p"))
        names = [F.col(f"`{c}`") for c in df.columns]
        return rows.join(found, rows["_v"] == found["_w"], "left").select(*names, F.coalesce("_p", F.lit(-1)).cast("int").alias("prediction"))


# -- the registry


@dataclass(frozen=True)
class Algorithm:
    key: str
    kind: str
    label: str
    params: dict[str, Param]
    make: Any

    def build(self, params: dict[str, Any] | None = None, seed: int = 0) -> Estimator:
        """An estimator; unknown parameters and values out of range raise ValueError."""
        given = params or {}
        if unknown := set(given) - set(self.params):
            raise ValueError(f"{self.key} has no {sorted(unknown)}")
        checked = {n: p.check(n, given.get(n)) for n, p in self.params.items()}
        if isinstance(self.make, type):
            return self.make(checked, seed)
        return Engine(self.make, self.kind, checked, seed)


def _i(default: int, low: int, high: int) -> Param:
    return Param("int", default, low, high)


def _f(default: float, low: float, high: float) -> Param:
    return Param("float", default, low, high)


CLASSIFY, REGRESS, CLUSTER = "classification", "regression", "clustering"
ALGORITHMS: dict[str, Algorithm] = {
    a.key: a
    for a in (
        Algorithm("random_forest", CLASSIFY, "Random forest", {"estimators": _i(100, 1, 1000), "ratio": _f(0.2, 0.01, 1.0), "max_depth": _i(10, 1, 30), "min_samples": _i(3, 1, 100)}, _random_forest),
        Algorithm("knn", CLASSIFY, "Nearest neighbours", {"k": _i(5, 1, 1000), "weighted": Param("bool", False)}, Neighbours),
        Algorithm("svc", CLASSIFY, "Support vectors", {"c": _f(1.0, 1e-4, 1e4), "kernel": Param("choice", "rbf", options=("rbf", "linear", "poly"))}, SupportVectors),
        Algorithm("naive_bayes", CLASSIFY, "Gaussian naive Bayes", {"priors": Param("list", None)}, GaussianBayes),
        Algorithm("ada_boost", CLASSIFY, "AdaBoost", {"estimators": _i(100, 1, 1000), "learning_rate": _f(1.0, 1e-3, 10.0)}, AdaBoost),
        Algorithm("gradient_boost", CLASSIFY, "Gradient boosting", {"estimators": _i(100, 1, 1000), "learning_rate": _f(0.1, 1e-3, 1.0), "max_depth": _i(3, 1, 30), "ratio": _f(0.8, 0.01, 1.0)}, _boost),
        Algorithm("logistic_regression", CLASSIFY, "Logistic regression", {"batch": _i(128, 1, 100_000), "optimizer": Param("choice", "adam", options=("adam", "sgd", "rmsprop", "momentum", "adagrad")), "l2": _f(1e-4, 0.0, 100.0), "epochs": _i(100, 1, 10_000)}, _logistic),
        Algorithm("decision_tree", CLASSIFY, "Decision tree", {"max_depth": _i(10, 1, 30), "min_samples": _i(3, 1, 100)}, _tree),
        Algorithm("ridge", REGRESS, "Ridge", {"alpha": _f(1.0, 0.0, 1e6)}, Ridge),
        Algorithm("lasso", REGRESS, "Lasso", {"alpha": _f(1.0, 0.0, 1e6)}, _lasso),
        Algorithm("svr", REGRESS, "Support vector regression", {"c": _f(1.0, 1e-4, 1e4), "epsilon": _f(0.1, 0.0, 100.0)}, SupportVectorRegressor),
        Algorithm("knn_regressor", REGRESS, "Nearest neighbours", {"k": _i(5, 1, 1000)}, NeighbourRegressor),
        Algorithm("gradient_boost_regressor", REGRESS, "Gradient boosting", {"estimators": _i(100, 1, 1000), "learning_rate": _f(0.1, 1e-3, 1.0), "max_depth": _i(3, 1, 30)}, _boost_regressor),
        Algorithm("regression_tree", REGRESS, "Regression tree", {"max_depth": _i(10, 1, 30)}, _regression_tree),
        Algorithm("kmeans", CLUSTER, "k-means", {"k": _i(3, 2, 1000), "epochs": _i(300, 1, 10_000), "min_change": _f(1e-4, 0.0, 1.0)}, _kmeans),
        Algorithm("dbscan", CLUSTER, "DBSCAN", {"radius": _f(0.5, 1e-9, 1e9), "min_samples": _i(5, 1, 100_000)}, Dbscan),
        Algorithm("gaussian_mixture", CLUSTER, "Gaussian mixture", {"k": _i(3, 2, 1000), "epochs": _i(100, 1, 10_000)}, _mixture),
    )
}


def describe() -> dict:
    """The registry as plain values."""
    return {k: {"type": a.kind, "label": a.label, "params": {n: {"type": p.kind, "default": p.default, "min": p.low, "max": p.high, "options": list(p.options)} for n, p in a.params.items()}} for k, a in ALGORITHMS.items()}


def registry_json() -> str:
    return json.dumps(describe())
