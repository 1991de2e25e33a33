"""Training, evaluation, cross-validation, search, comparison and persistence of whole pipelines."""

from __future__ import annotations

import itertools
import json
import random
import resource
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from . import dataset, metrics, stages
from .estimators import ALGORITHMS, Model

#: Metrics of which less is better.
FALLING = ("rmse", "mae", "mse")


@dataclass
class Pipeline(Model):
    """Fitted stages and a model; features are bound by name."""

    steps: list[stages.Stage]
    model: Model
    features: list[str]
    task: str

    @property
    def classes(self):  # type: ignore[override]
        return self.model.classes

    def transform(self, df: DataFrame) -> DataFrame:
        """df with predictions, row by row: the columns given go along in a struct, so nothing is joined back."""
        own = [c for c in df.columns if c == "row_idx" or c in self.features]
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_given"), *[F.col(f"`{c}`") for c in own])
        if "row_idx" not in own:
            rows = rows.withColumn("row_idx", F.monotonically_increasing_id())
        made = self.model.transform(stages.apply_stages(self.steps, rows))
        return made.select("_given.*", "prediction", *(["probability"] if "probability" in made.columns else []))


def fit(df: DataFrame, features: list[str], algorithm: str, params: dict | None = None, config: dict | None = None, seed: int = 0) -> Pipeline:
    """Stages by config and the algorithm, fitted to df (features, label, row_idx)."""
    a = ALGORITHMS[algorithm]
    steps = stages.build_stages(config)
    names = [c for c in features if c not in (config or {}).get("drop_columns", [])]
    ready = stages.fit_stages(steps, df.select("row_idx", *[F.col(f"`{c}`") for c in names], *(["label"] if "label" in df.columns else [])))
    inputs = [c for c in ready.columns if c not in ("row_idx", "label")]
    return Pipeline(steps, a.build(params, seed).fit(ready, inputs), names, a.kind)


def scored(pipeline: Pipeline, df: DataFrame) -> DataFrame:
    return pipeline.transform(df).select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))


def evaluate(pipeline: Pipeline, df: DataFrame) -> dict:
    """Metrics of the task; for clusters their sizes and the silhouette."""
    if pipeline.task == "clustering":
        made = pipeline.transform(df)
        sizes = {str(r.prediction): r.n for r in made.groupBy("prediction").agg(F.count("*").alias("n")).collect()}
        return {"cluster_sizes": sizes, "silhouette": silhouette(made, pipeline.features)}
    pairs = scored(pipeline, df)
    if pipeline.task == "regression":
        row = metrics.regression(pairs).first()
        return row.asDict() if row else {}
    per = {r["class"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in metrics.per_class(pairs).collect()}
    out = {"accuracy": metrics.accuracy(pairs).first()[0], **metrics.macro(pairs).first().asDict(), "mcc": metrics.mcc(pairs).first()[0], "per_class": per}
    out["confusion"] = [r.asDict() for r in metrics.confusion(pairs).orderBy(*metrics.class_order("actual"), *metrics.class_order("predicted")).collect()]
    return out


def silhouette(df: DataFrame, features: list[str]) -> float | None:
    """The mean silhouette by squared distance, from cluster sums alone; null for one cluster."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    kinds = dict(df.dtypes)
    numeric = [c for c in features if kinds[c] in ("double", "float", "int", "bigint")]
    if not numeric or df.select("prediction").distinct().count() < 2:
        return None
    data = df.select(array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in numeric])).alias("features"), F.col("prediction").cast("double").alias("prediction"))
    return round(ClusteringEvaluator().evaluate(data), 4)


def cross_validate(df: DataFrame, features: list[str], algorithm: str, params: dict | None = None, config: dict | None = None, folds: int = 5, metric: str | None = None, seed: int = 0) -> dict:
    """Scores of contiguous folds, each by a pipeline fitted to the other rows; folds too small are left out."""
    metric = metric or ("rmse" if ALGORITHMS[algorithm].kind == "regression" else "accuracy")
    marked = dataset.fold(df, folds).persist()
    out = []
    for k in range(folds):
        train, test = dataset.train_and_validation(marked, k)
        if train.count() < 10 or test.count() < 2:
            continue
        out.append(score(fit(train.drop("fold"), features, algorithm, params, config, seed), test.drop("fold"), metric))
    marked.unpersist()
    return metrics.scores_summary([s for s in out if s is not None])


def score(pipeline: Pipeline, df: DataFrame, metric: str) -> float | None:
    found = evaluate(pipeline, df)
    return found.get({"f1": "f1", "r2": "r2"}.get(metric, metric))


@dataclass
class Run:
    algorithm: str
    params: dict
    status: str
    metrics: dict = field(default_factory=dict)
    cv: dict = field(default_factory=dict)
    importances: dict | None = None
    pipeline: Pipeline | None = None
    seconds: float = 0.0
    error: str | None = None
    memory: int = 0  # the driver process's peak, bytes


def train(df: DataFrame, features: list[str], algorithm: str, params: dict | None = None, config: dict | None = None, folds: int | None = None, seed: int = 0) -> Run:
    """Split by config's train_ratio, fit, evaluate, cross-validate; failures are recorded, not raised."""
    began = time.time()
    c = stages.DEFAULTS | (config or {})
    kind = ALGORITHMS[algorithm].kind
    try:
        if kind == "clustering":
            part, rest = df, df
        elif kind == "regression":
            part, rest = dataset.hash_split(df, c["train_ratio"], seed)
        else:
            part, rest = dataset.stratified_split(df, c["train_ratio"], seed)
        made = fit(part, features, algorithm, params, config, seed)
        cv = {} if kind == "clustering" else cross_validate(df, features, algorithm, params, config, folds or c["cv_folds"], seed=seed)
        return Run(algorithm, params or {}, "completed", evaluate(made, rest), cv, made.model.importances, made, time.time() - began, memory=_peak())
    except Exception as e:  # noqa: BLE001
        return Run(algorithm, params or {}, "failed", seconds=time.time() - began, error=str(e)[:500], memory=_peak())


def _peak() -> int:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def record(catalog: Catalog, project: int, run: Run, path: str | None = None) -> int:
    """The id of the run's row in the catalog; the pipeline is stored under path/id where one is given."""
    id_ = catalog.insert("model_runs", project_id=project, algorithm=run.algorithm, algo_class=ALGORITHMS[run.algorithm].kind, hyperparams=json.dumps(run.params), status="training")
    where = f"{path}/{id_}" if path and run.pipeline else None
    if where:
        save(run.pipeline, where)
    found = {k: v for k, v in run.metrics.items() if k != "confusion"}
    catalog.update(
        "model_runs", id_, status=run.status, metrics=json.dumps(found), cv_scores=json.dumps(run.cv), confusion_matrix=json.dumps(run.metrics.get("confusion")),
        feature_importances=json.dumps(run.importances), model_path=where, train_time=run.seconds, memory_peak=run.memory, error_msg=run.error,
    )
    return id_


def train_all(df: DataFrame, features: list[str], algorithms: list[dict], config: dict | None = None, folds: int | None = None, parallel: int = 1, catalog: Catalog | None = None, project: int = 0, path: str | None = None) -> list[Run]:
    """A run for each {key, params}; unknown keys are passed over. parallel runs share the cached table.

    A catalog given gets a row for each run, and the project its status and best run; path, where one is given, the pipelines.
    """
    known = [a for a in algorithms if a.get("key") in ALGORITHMS]
    df = df.persist()
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        out = list(pool.map(lambda a: train(df, features, a["key"], a.get("params"), config, folds), known))
    df.unpersist()
    if catalog:
        ids = [record(catalog, project, run, path) for run in out]
        best = best_run(out, ALGORITHMS[known[0]["key"]].kind) if known else None
        if catalog.find("projects", project):
            catalog.update("projects", project, status="trained" if best else "created", best_model_id=ids[[run is best for run in out].index(True)] if best else None)
    return out


def best_run(runs: list[Run], task: str) -> Run | None:
    """Most accurate, or least rmse; the first of equals; none where all failed."""
    done = [r for r in runs if r.status == "completed"]
    key = (lambda r: -r.metrics.get("rmse", 999)) if task == "regression" else (lambda r: r.metrics.get("accuracy", 0))
    return max(done, key=key, default=None)


def grid(values: dict[str, list]) -> list[dict]:
    """Every combination, the last name varying fastest."""
    return [dict(zip(values, c, strict=True)) for c in itertools.product(*values.values())]


def search(df: DataFrame, features: list[str], algorithm: str, values: dict[str, list], method: str = "grid", metric: str = "accuracy", folds: int = 5, max_iter: int = 20, config: dict | None = None, seed: int = 0) -> dict:
    """All combinations, or max_iter drawn from them; trials best first, failures last, the first of equals first."""
    combos = grid(values)
    if method == "random":
        combos = random.Random(seed).sample(combos, min(max_iter, len(combos)))
    elif method != "grid":
        raise ValueError(f"method {method}")
    trials: list[dict] = []
    df = df.persist()
    for params in combos:
        try:
            cv = cross_validate(df, features, algorithm, params, config, folds, metric, seed)
            trials.append({"params": params, "score": cv["mean"] if cv["scores"] else None, "error": None if cv["scores"] else "no fold was large enough"})
        except Exception as e:  # noqa: BLE001
            trials.append({"params": params, "score": None, "error": str(e)[:300]})
    df.unpersist()
    return {"trials": rank_trials(trials, metric), "best": next((t for t in rank_trials(trials, metric) if t["score"] is not None), None)}


def rank_trials(trials: list[dict], metric: str) -> list[dict]:
    sign = 1 if metric in FALLING else -1
    return sorted(trials, key=lambda t: (t["score"] is None, sign * (t["score"] or 0)))


def learning_curve(df: DataFrame, features: list[str], algorithm: str, shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), params: dict | None = None, config: dict | None = None, seed: int = 0) -> list[dict]:
    """The held-out score by the share of the training rows that was used."""
    kind = ALGORITHMS[algorithm].kind
    part, rest = dataset.hash_split(df, 0.8, seed)
    metric = "rmse" if kind == "regression" else "accuracy"
    return [{"share": s, metric: score(fit(dataset.hash_split(part, s, seed + 1)[0] if s < 1 else part, features, algorithm, params, config, seed), rest, metric)} for s in shares]


def select_features(df: DataFrame, features: list[str], k: int, regression: bool = False) -> list[str]:
    """The k numeric features of largest F statistic against the label, from one aggregation."""
    if regression:
        row = df.agg(*[F.abs(F.corr(F.col(f"`{c}`").cast("double"), F.col("label").cast("double"))).alias(f"c{i}") for i, c in enumerate(features)]).first()
        value = {c: row[f"c{i}"] or 0.0 for i, c in enumerate(features)}
    else:
        aggs = [f(F.col(f"`{c}`").cast("double")).alias(f"{k_}{i}") for i, c in enumerate(features) for k_, f in (("m", F.avg), ("v", F.var_pop))]
        rows = df.groupBy("label").agg(F.count("*").alias("n"), *aggs).collect()  # one a class
        n = sum(r.n for r in rows)
        value = {}
        for i, c in enumerate(features):
            mean = sum(r.n * r[f"m{i}"] for r in rows) / n
            between, within = sum(r.n * (r[f"m{i}"] - mean) ** 2 for r in rows), sum(r.n * r[f"v{i}"] for r in rows)
            value[c] = between / max(len(rows) - 1, 1) / max(within / max(n - len(rows), 1), 1e-12)
    return sorted(features, key=lambda c: (-value[c], features.index(c)))[:k]


def _store(m: Model, path: str) -> dict[str, Any]:
    """What describes a model; what is too large for that is written under path."""
    from . import estimators as E

    if isinstance(m, E.SparkModel):
        for k, part in enumerate(m.stages):
            part.write().overwrite().save(f"{path}/part{k}")
        return {"model": "engine", "inputs": m.features, "classes": m.classes, "importances": m.importances, "parts": [f"{type(x).__module__}.{type(x).__name__}" for x in m.stages]}
    if isinstance(m, E.LinearModel):
        return {"model": "linear", "inputs": m.features, "weights": m.weights, "intercept": m.intercept}
    if isinstance(m, E._BayesModel):
        return {"model": "bayes", "inputs": m.features, "classes": m.classes, "table": m.table}
    if isinstance(m, E._BoostModel):
        return {"model": "boost", "inputs": m.features, "classes": m.classes, "found": [(a, vars(x)) for a, x in m.found]}
    if isinstance(m, E._NeighbourModel):
        m.train.write.mode("overwrite").parquet(f"{path}/train")
        return {"model": "neighbours", "inputs": m.features, "classes": m.classes, "k": m.k, "weighted": m.weighted, "regression": m.regression}
    if isinstance(m, E._DbscanModel):
        m.cores.write.mode("overwrite").parquet(f"{path}/cores")
        return {"model": "density", "inputs": m.features, "radius": m.radius}
    if isinstance(m, E._Mapped):
        return {"model": "mapped", "map": m.mapped.to_dict(), "of": _store(m.model, path)}
    raise ValueError(f"{type(m).__name__} can't be stored")


def _restore(spark, head: dict[str, Any], path: str) -> Model:
    import importlib

    from . import estimators as E

    kind = head["model"]
    if kind == "engine":
        parts = []
        for k, name in enumerate(head["parts"]):
            module, _, cls = name.rpartition(".")
            parts.append(getattr(importlib.import_module(module), cls).load(f"{path}/part{k}"))
        return E.SparkModel(parts, head["inputs"], head["classes"], head["importances"])
    if kind == "linear":
        return E.LinearModel(head["inputs"], head["weights"], head["intercept"])
    if kind == "bayes":
        return E._BayesModel(head["classes"], head["inputs"], head["table"])
    if kind == "boost":
        return E._BoostModel([(a, E._Stump(**x)) for a, x in head["found"]], head["inputs"], head["classes"])
    if kind == "density":
        return E._DbscanModel(spark.read.parquet(f"{path}/cores"), head["inputs"], head["radius"])
    if kind == "mapped":
        return E._Mapped(E._FeatureMap.from_dict(head["map"]), _restore(spark, head["of"], path))
    return E._NeighbourModel(spark.read.parquet(f"{path}/train"), head["inputs"], head["k"], head["weighted"], head["regression"], head["classes"])


def save(pipeline: Pipeline, path: str) -> None:
    """Stages and model under a path that the session can write: JSON beside the engine's own format."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    head = {"features": pipeline.features, "task": pipeline.task, "stages": stages.to_json(pipeline.steps)} | _store(pipeline.model, path)
    spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def load(spark, path: str) -> Pipeline:
    head = json.loads(spark.read.parquet(f"{path}/head").first().head)
    return Pipeline(stages.from_json(head["stages"]), _restore(spark, head, path), head["features"], head["task"])


def predict_rows(pipeline: Pipeline, df: DataFrame) -> DataFrame:
    """(row, prediction) for a batch."""
    return pipeline.transform(df).select(F.col("row_idx").alias("row"), "prediction").orderBy("row")


def predict_one(spark, pipeline: Pipeline, values: dict[str, Any], catalog: Catalog | None = None, project: int = 0, run: int = 0) -> dict:
    """{prediction, probabilities by class (where the model has them)} of one row of values by feature.

    A feature that is not there raises ValueError; others are passed over. A catalog given gets a row in its log.
    """
    if absent := [c for c in pipeline.features if c not in values]:
        raise ValueError(f"no value for {absent}")
    given = [values[c] for c in pipeline.features]
    kinds = ", ".join(f"`{c}` {'double' if isinstance(v, int | float) else 'string'}" for c, v in zip(pipeline.features, given, strict=True))
    row = spark.createDataFrame([tuple(float(v) if isinstance(v, int | float) else v for v in given)], kinds)
    made = pipeline.transform(row).first().asDict()
    shares = made.get("probability")
    found = {"prediction": made["prediction"], "probabilities": dict(zip(pipeline.classes, map(float, shares), strict=True)) if shares is not None and pipeline.classes else None}
    if catalog:
        catalog.log_prediction(project_id=project, model_run_id=run, input_data=json.dumps(dict(zip(pipeline.features, given, strict=True))), prediction=str(found["prediction"]), probabilities=json.dumps(found["probabilities"]))
    return found
