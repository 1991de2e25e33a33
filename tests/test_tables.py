import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.functions.text import float_value, is_numeric
from lattice.operators import dataset, estimators, export, metrics, profile, stages, tuning
from lattice.sources import tables
from lattice.sources.catalog import Catalog, validate


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_numbers_in_text(spark):
    cases = {"12": (1, 12), " 12 ": (1, 12), "1e5": (1, 1e5), ".5": (1, 0.5), "5.": (1, 5), "1d": (0, 1), "NaN": (0, 0), "inf": (0, 0), "0x1A": (0, 0), "": (0, 0), "12abc": (0, 12), "-3.5kg": (0, -3.5), "+7": (1, 7), None: (0, 0)}
    df = frame(spark, [(x,) for x in cases], "x string").select("x", is_numeric(F.col("x")).cast("int").alias("n"), float_value(F.col("x")).alias("v"))
    assert {r.x: (r.n, r.v) for r in df.collect()} == cases


def test_kinds(spark):
    df = frame(spark, [(i, str(i) if i < 95 else "x", str(i) if i < 94 else "x", f"c{i % 20}", f"c{i % 21}", "", str(i) if i < 100 else "t") for i in range(120)], "row_idx long, a string, b string, c string, d string, e string, late string")
    assert profile.kind_map(df) == {"a": "continuous", "b": "string", "c": "categorical", "d": "string", "e": "unknown", "late": "continuous"}
    assert profile.task_type({"x": "string", "y": "continuous"}) == ("y", "regression") and profile.task_type({"y": "continuous", "x": "string"}) == ("x", "classification")


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8, 1000])
def test_quantiles_are_floor_index(spark, n):
    rng = random.Random(n)
    values = [float(rng.randrange(50)) if n < 100 else rng.random() for _ in range(n)]
    df = frame(spark, [(i, x) for i, x in enumerate(values)], "row_idx long, x double")
    r = profile.summary(df, ["x"]).first()
    s = sorted(values)
    assert (r.q25, r.q75) == (s[int(n * 0.25)], s[int(n * 0.75)]) and r.median == round(float(np.median(s)), 4) and r.std == pytest.approx(np.std(s), abs=1e-4)
    got = {x.q: x.v for x in profile.order_statistics(df.select(F.lit("x").alias("name"), F.col("x").alias("v")), [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: s[0], 0.5: s[n // 2], 1.0: s[-1]}


def test_profile_of_odd_columns(spark):
    df = frame(spark, [(i, 7.0, "", "b" if i % 2 else "a", None if i < 3 else "x") for i in range(10)], "row_idx long, same double, blank string, tie string, holes string")
    p = profile.profile(df)
    assert p["same"]["histogram"] == [{"bin": 7.0, "count": 10}] and p["same"]["skewness"] == 0 and p["blank"]["missing"] == 10 and p["blank"]["unique"] == 1 and "mean" not in p["blank"]
    assert list(p["tie"]["value_counts"].items()) == [("a", 5), ("b", 5)] and p["holes"]["missing_pct"] == 30.0
    assert [(r.a, r.b, r.r) for r in profile.correlation(df.withColumn("y", F.col("row_idx").cast("double")), ["same", "y"]).orderBy("a", "b").collect()] == [("same", "same", 0.0), ("same", "y", 0.0), ("y", "same", 0.0), ("y", "y", 1.0)]
    with pytest.raises(KeyError):
        profile.distribution(p, "none")
    assert profile.missing(df.limit(0), ["tie"]).count() == 0


def test_histogram_and_skew(spark):
    df = frame(spark, [(i, x) for i, x in enumerate([1.0, 2.0, 4.0, 11.0])], "row_idx long, x double")
    h = [(r.bin, r.edge, r.n) for r in profile.histogram(df, ["x"]).orderBy("bin").collect()]
    assert [n for _, _, n in h] == [1, 1, 0, 1, 0, 0, 0, 0, 0, 1] and h[1][1] == 2.0
    assert profile.summary(df.where("x < 5"), ["x"]).first().skewness == 0.3818


def test_dataset(spark):
    df = frame(spark, [(0, "1", "a", "y"), (1, "", "", "y"), (2, "3x", None, ""), (3, None, "b", None), (4, "5", "c", "n")], "row_idx long, n string, c string, label string")
    kinds = {"n": "continuous", "c": "categorical"}
    got = {r.row_idx: (r.n, r.c, r.label) for r in dataset.build_dataset(df, ["n", "c"], "label", kinds).collect()}
    assert set(got) == {0, 1, 4} and got[0] == (1.0, "a", "y") and np.isnan(got[1][0]) and got[1][1] == "?"
    un = {r.row_idx: (r.n, r.c) for r in dataset.build_unlabeled(df, ["n", "c"], kinds).collect()}
    assert un[1] == (0.0, "") and un[2] == (3.0, "?") and un[3] == (0.0, "b")


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 3).cast("string")).alias("label"))
    train, test = dataset.stratified_split(df, 0.8, 3)
    assert train.count() + test.count() == 1000 and train.intersect(test).count() == 0
    n = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    assert {r.label: r["count"] for r in train.groupBy("label").count().collect()} == {k: int(0.8 * v) for k, v in n.items()}
    a, b = dataset.hash_split(df, 0.8, 1)
    assert a.count() + b.count() == 1000 and 740 < a.count() < 860
    f = dataset.fold(df.limit(23), 5)
    assert f.where("fold IS NULL").count() == 3 and f.where("fold = 4").count() == 4


def test_stages(spark):
    df = frame(spark, [(0, "1", "a", 5.0, "y"), (1, "", "b", 5.0, "n"), (2, "3", "?", 5.0, "y"), (3, "8", "b", 5.0, "y")], "row_idx long, n string, c string, k double, label string")
    steps = stages.build_stages({"variance_threshold": 1e-9, "polynomial_degree": 2})
    out = stages.fit_stages(steps, df)
    assert out.columns == ["row_idx", "n", "n^2", "c=a", "c=a^2", "c=b", "c=b^2", "label"]
    x = [r.n for r in out.orderBy("row_idx").collect()]
    assert np.mean(x) == pytest.approx(0) and np.std(x) == pytest.approx(1) and x[1] == pytest.approx(0)
    again = stages.apply_stages(stages.from_json(stages.to_json(steps)), df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    unseen = frame(spark, [(9, "2", "zzz", 1.0, "y")], df.schema)
    assert stages.apply_stages(steps, unseen).first()["c=a^2"] is not None
    with pytest.raises(ValueError):
        stages.Scale("none")
    assert stages.Scale("min_max").fit(df).transform(df).first().k == 0.0


def test_pca_and_lda(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [5, 1, 0.1]
    label = ["a" if i % 2 else "b" for i in range(200)]
    x[:, 1] += np.where(np.array(label) == "a", 4, -4)
    df = frame(spark, [(i, *map(float, r), l) for i, (r, l) in enumerate(zip(x, label, strict=True))], "row_idx long, p double, q double, r double, label string")
    out = stages.Pca(2).fit(df).transform(df).toPandas()
    c = x - x.mean(axis=0)
    want = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(out[["pc0", "pc1"]].to_numpy()), np.abs(want[0][:, :2] * want[1][:2]))
    d = stages.LinearDiscriminants(1).fit(df).transform(df).toPandas()
    assert d.groupby("label").ld0.mean().diff().abs().iloc[-1] > 6 * d.groupby("label").ld0.std().max() ** 0.5


def test_metrics(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] * 2 + [("b", "b")] * 4 + [("c", "a")]
    df = frame(spark, pairs, "actual string, predicted string")
    per = {r["class"]: r for r in metrics.per_class(df).collect()}
    assert (per["a"].precision, per["a"].recall, per["c"].f1, per["c"].support) == (0.75, 0.6, 0.0, 1)
    assert metrics.accuracy(df).first()[0] == 0.7 and metrics.mcc(df).first()[0] == round((0.7 - 1 / 3) / (2 / 3), 4) and metrics.confusion(df).count() == 9
    two = frame(spark, [("0", "0")] * 5 + [("1", "1")] * 3 + [("0", "1"), ("1", "0")], "actual string, predicted string")
    assert metrics.mcc(two).first()[0] == metrics.mcc_multiclass(two).first()[0] == 0.5833
    one = frame(spark, [("x", "x")], "actual string, predicted string")
    assert metrics.mcc(one).first()[0] is None and metrics.accuracy(one.limit(0)).first()[0] is None
    reg = frame(spark, [(1.0, 2.0), (3.0, 3.0)], "actual double, predicted double")
    assert tuple(metrics.regression(reg).first()) == (0.7071, 0.5, 0.5, 0.5) and metrics.regression(reg.limit(0)).count() == 0
    assert metrics.regression(frame(spark, [(1.0, 1.0)], "actual double, predicted double")).first().r2 == 0
    order = [r["class"] for r in metrics.classes(frame(spark, [("10", "9"), ("x", "2")], "actual string, predicted string")).collect()]
    assert order == ["2", "9", "10", "x"]
    scores = frame(spark, [(i % 2 == 0, (i + (40 if i % 2 == 0 else 0)) / 100) for i in range(60)], "y boolean, s double")
    y, s = np.array([i % 2 == 0 for i in range(60)]), np.array([(i + (40 if i % 2 == 0 else 0)) / 100 for i in range(60)])
    want = ((s[y][:, None] > s[~y][None, :]) + 0.5 * (s[y][:, None] == s[~y][None, :])).mean()
    assert metrics.auc(metrics.roc(scores, F.col("y"), F.col("s"))) == pytest.approx(want, abs=0.01)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centres = {"a": (0, 0), "b": (6, 0), "c": (0, 6)}
    rows = [(i, *(float(v) for v in rng.normal(centres[k], 0.6)), k) for i, k in enumerate("abc" * 30)]
    return spark.createDataFrame(rows, "row_idx long, x double, y double, label string").persist()


SMALL = {"random_forest": {"estimators": 10, "ratio": 1.0}, "svc": {"kernel": "rbf"}, "ada_boost": {"estimators": 6}, "gradient_boost": {"estimators": 3}, "logistic_regression": {"epochs": 20}}


@pytest.mark.parametrize("key", [k for k, a in estimators.ALGORITHMS.items() if a.kind == "classification"])
def test_classifiers(blobs, key):
    model = estimators.ALGORITHMS[key].build(SMALL.get(key)).fit(blobs, ["x", "y"])
    out = model.transform(blobs)
    assert model.classes == ["a", "b", "c"] and out.where("prediction = label").count() >= 85
    if "probability" in out.columns:
        assert all(sum(r.probability) == pytest.approx(1) for r in out.limit(5).collect())


@pytest.mark.parametrize("key", [k for k, a in estimators.ALGORITHMS.items() if a.kind == "regression"])
def test_regressors(blobs, key):
    df = blobs.withColumn("label", F.col("x") * 2 - F.col("y") + 1)
    params = {"lasso": {"alpha": 0.01}, "ridge": {"alpha": 1e-6}}.get(key)
    out = estimators.ALGORITHMS[key].build(params).fit(df, ["x", "y"]).transform(df)
    assert metrics.regression(out.select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))).first().r2 > 0.9


@pytest.mark.parametrize("key,params", [("kmeans", {"k": 3}), ("gaussian_mixture", {"k": 3, "epochs": 30}), ("dbscan", {"radius": 1.2, "min_samples": 4})])
def test_clusterers(blobs, key, params):
    out = estimators.ALGORITHMS[key].build(params).fit(blobs, ["x", "y"]).transform(blobs)
    assert out.groupBy("label").agg(F.mode("prediction").alias("m")).select("m").distinct().count() >= (2 if key == "gaussian_mixture" else 3)
    assert out.count() == 90


def test_dbscan_follows_a_long_chain(spark):
    """One chain of 3,000 rows whose ids don't rise along it, a pair apart from it, and noise."""
    ids = np.random.default_rng(5).permutation(3000).tolist()
    df = spark.createDataFrame([(i, float(k), 0.0) for k, i in enumerate(ids)] + [(3000, 0.0, 9.0), (3001, 1.0, 9.0), (3002, 0.0, 99.0)], "row_idx long, x double, y double")
    out = estimators.ALGORITHMS["dbscan"].build({"radius": 1.0, "min_samples": 2}).fit(df, ["x", "y"]).transform(df)
    assert {(r.prediction, r["count"]) for r in out.groupBy("prediction").count().collect()} == {(0, 3000), (1, 2), (-1, 1)}


def test_dbscan_scores_other_rows_by_distance(spark):
    """Rows without an index, or with one of the training table's, go by their place alone."""
    df = spark.createDataFrame([(k, float(k % 5), 10.0 * (k // 5)) for k in range(10)], "row_idx long, x double, y double")
    model = estimators.ALGORITHMS["dbscan"].build({"radius": 1.0, "min_samples": 3}).fit(df, ["x", "y"])
    other = spark.createDataFrame([(0, 2.0, 10.5), (1, 2.5, 0.25), (2, 2.0, 5.0), (3, None, 0.0)], "row_idx long, x double, y double")
    assert [r.prediction for r in model.transform(other).orderBy("row_idx").collect()] == [1, 0, -1, -1]
    assert sorted(r.prediction for r in model.transform(other.drop("row_idx")).collect()) == [-1, -1, 0, 1]


def test_dbscan_lists_no_pairs(spark, monkeypatch):
    """1,500 rows of 64 components, all in reach of each other, make a few rows each, not a row for each pair."""
    import sys

    from lattice.session import materialise

    v, written = np.random.default_rng(2).normal(size=(1500, 64)) / 20, []

    def counted(df):
        out = materialise(df)
        written.append(out.count())
        return out

    for m in [m for k, m in sys.modules.items() if k.startswith("lattice.operators") and hasattr(m, "materialise")]:
        monkeypatch.setattr(m, "materialise", counted)
    names = [f"x{k}" for k in range(64)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(v.tolist())], "row_idx long, " + ", ".join(f"{n} double" for n in names))
    out = estimators.ALGORITHMS["dbscan"].build({"radius": 1.15}).fit(df, names).transform(df)
    assert {(r.prediction, r["count"]) for r in out.groupBy("prediction").count().collect()} == {(0, 1500)}
    assert written and max(written) <= 20 * 1500


def clusters(x, radius, least):
    """DBSCAN by all distances."""
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= radius * radius
    core = np.flatnonzero(near.sum(1) >= least)
    name, out = {}, np.full(len(x), -1)
    for c in core.tolist():
        if c not in name:
            k, todo = len(set(name.values())), [c]
            while todo:
                if (at := todo.pop()) not in name:
                    name[at] = k
                    todo += np.intersect1d(np.flatnonzero(near[at]), core).tolist()
    for i in range(len(x)):
        out[i] = min((name[c] for c in core[near[i][core]].tolist()), default=-1)
    return out.tolist()


@pytest.mark.parametrize("width,spread,radius,piece", [(1, 60.0, 0.12, None), (3, 1.5, 0.25, 9_000), (7, 1.0, 0.62, 9_000)])
def test_dbscan_equals_all_distances(spark, monkeypatch, width, spread, radius, piece):
    """In one piece or several, by few or many components, with rows on the border of each other's reach."""
    from lattice.operators import reach

    if piece:
        monkeypatch.setattr(reach, "PIECE", piece)
        monkeypatch.setattr(reach, "PACK", piece // 3)
    x = np.random.default_rng(width).uniform(-spread, spread, size=(1300, width)).round(1 if width < 7 else 3)
    x[600:] = x[600:] / 4 + 1e4
    names = [f"x{k}" for k in range(width)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "row_idx long, " + ", ".join(f"{n} double" for n in names))
    out = estimators.ALGORITHMS["dbscan"].build({"radius": radius, "min_samples": 4}).fit(df, names).transform(df)
    want = clusters(x, radius, 4)
    assert len(set(want)) > 3 and [r.prediction for r in out.orderBy("row_idx").collect()] == want


def test_reach_is_exact():
    from lattice.operators import reach

    rng = np.random.default_rng(8)
    for x, y, radius in ((rng.integers(-3, 4, (200, 2)).astype(float), rng.integers(-3, 4, (150, 2)).astype(float), 5.0), (rng.normal(size=(90, 30)) + 1e9, rng.normal(size=(80, 30)) + 1e9, 7.5), (rng.normal(size=(50, 3)) * 1e200, rng.normal(size=(50, 3)), 1.0)):
        with np.errstate(over="ignore"):
            far = sum((x[:, None, c] - y[None, :, c]) ** 2 for c in range(x.shape[1]))
        assert np.array_equal(reach.near(x, y, radius), far <= radius * radius)


def test_dbscan_of_odd_rows(spark):
    """Rows with a component that is no finite number are noise; a feature may be named like the model's own columns."""
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 0.0), (2, 1.0, -0.0), (3, None, 0.0), (4, nan, 0.0), (5, inf, 0.0), (6, -inf, 0.0), (7, 1e300, 0.0), (8, nan, 0.0), (9, inf, 0.0)], "row_idx long, v double, least double")
    for key, least in ((3, [0, 0, 0] + [-1] * 7), (1, [0, 0, 0] + [-1] * 4 + [1, -1, -1])):
        model = estimators.ALGORITHMS["dbscan"].build({"radius": 1e-9, "min_samples": key}).fit(df, ["v", "least"])
        assert [r.prediction for r in model.transform(df).orderBy("row_idx").collect()] == least
    assert [r.prediction for r in model.transform(df.limit(0)).collect()] == []
    none = estimators.ALGORITHMS["dbscan"].build({"radius": 1.0, "min_samples": 50}).fit(df, ["v", "least"])
    assert {r.prediction for r in none.transform(df).collect()} == {-1}


def test_connected_keeps_lone_nodes(spark):
    edges = spark.createDataFrame([(4, 4), (9, 7), (7, 8), (8, 8)], "u long, v long")
    assert {tuple(r) for r in estimators.connected(edges).collect()} == {(4, 4), (9, 7), (7, 7), (8, 7)}


def test_knn_in_blocks(blobs, monkeypatch):
    df = blobs.select("row_idx", F.array("x", "y").alias("v"))
    train = df.select(F.col("row_idx").alias("t"), "v")
    whole = sorted(map(tuple, estimators.nearest(df, train, 3).select("key", F.round("d", 9), "t").collect()))
    monkeypatch.setattr(estimators, "KNN_BLOCK", 400)
    assert sorted(map(tuple, estimators.nearest(df, train, 3).select("key", F.round("d", 9), "t").collect())) == whole


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_knn_ties_in_large_tables(shift):
    """Rounded columns have many equal distances; the smaller t comes first at every size."""
    v = np.random.default_rng(3).normal(size=(60_000, 4)).round(2) + shift
    v[:40] = v[100:140]
    asked = np.concatenate([np.arange(200), np.arange(1000, 1200)])
    got = estimators._nearest_batch(asked, v[asked], np.arange(len(v)), v, 5).to_pydict()
    for n, i in enumerate(asked.tolist()):
        d = np.sqrt(((v[i] - v) ** 2).sum(axis=1))
        want = np.argsort(d, kind="stable")[:5]
        assert got["t"][5 * n : 5 * n + 5] == want.tolist() and got["d"][5 * n : 5 * n + 5] == d[want].tolist()


def test_registry_enforces_ranges():
    for bad in ({"k": 0}, {"nothing": 1}, {"k": 10**9}):
        with pytest.raises(ValueError):
            estimators.ALGORITHMS["knn"].build(bad)
    assert json.loads(estimators.registry_json())["svc"]["params"]["kernel"]["options"] == ["rbf", "linear", "poly"]


@pytest.mark.parametrize("key", ["random_forest", "decision_tree", "regression_tree"])
def test_depth_is_never_cut(key):
    """The engine's trees go 30 deep; more is refused, not cut."""
    assert estimators.ALGORITHMS[key].build({"max_depth": 30}).params["max_depth"] == 30
    with pytest.raises(ValueError):
        estimators.ALGORITHMS[key].build({"max_depth": 31})


def test_pipeline_save_load_and_search(spark, blobs, tmp_path):
    df = blobs.withColumn("c", F.when(F.col("row_idx") % 4 == 0, "").otherwise(F.col("label")))
    for key in ("naive_bayes", "decision_tree", "knn"):
        p = tuning.fit(df, ["x", "y", "c"], key)
        tuning.save(p, f"{tmp_path}/{key}")
        again = tuning.load(spark, f"{tmp_path}/{key}")
        want = sorted(map(tuple, tuning.predict_rows(p, df).collect()))
        assert sorted(map(tuple, tuning.predict_rows(again, df).collect())) == want
    shuffled = df.select("c", "y", "x", "row_idx")
    assert sorted(map(tuple, tuning.predict_rows(p, shuffled).collect())) == want
    cv = tuning.cross_validate(df, ["x", "y"], "naive_bayes", folds=3)
    assert len(cv["scores"]) == 3 and cv["mean"] > 0.9
    found = tuning.search(df, ["x", "y"], "naive_bayes", {"priors": [None]}, metric="accuracy", folds=2)
    assert found["best"]["score"] > 0.9
    runs = tuning.train_all(df, ["x", "y"], [{"key": "naive_bayes"}, {"key": "knn", "params": {"k": 0}}, {"key": "none"}], folds=2)
    assert [r.status for r in runs] == ["completed", "failed"] and tuning.best_run(runs, "classification") is runs[0] and tuning.best_run(runs[1:], "classification") is None
    assert tuning.evaluate(tuning.fit(df, ["x", "y"], "kmeans"), df)["silhouette"] > 0.7


def test_runs_and_single_predictions_are_recorded(spark, blobs, tmp_path):
    df, c = blobs, Catalog(spark, f"file://{tmp_path}/catalog")
    project = c.insert("projects", name="p", status="created")
    asked = [{"key": "ada_boost", "params": {"estimators": 4}}, {"key": "knn", "params": {"k": 0}}]
    tuning.train_all(df, ["x", "y"], asked, folds=2, catalog=c, project=project, path=f"file://{tmp_path}/models")
    good, bad = c.table("model_runs").orderBy("id").collect()
    assert (good.status, bad.status) == ("completed", "failed") and good.memory_peak > 0 and bad.error_msg and json.loads(good.metrics)["accuracy"] > 0.5
    assert c.find("projects", project)["best_model_id"] == good.id and c.progress(project) == {"training": 0, "completed": 1, "failed": 1, "tuned": 0}
    pipeline = tuning.load(spark, good.model_path)
    row = df.first()
    found = tuning.predict_one(spark, pipeline, {"x": row.x, "y": row.y, "other": 1}, c, project, good.id)
    assert found["prediction"] == max(found["probabilities"], key=found["probabilities"].get) and sum(found["probabilities"].values()) == pytest.approx(1)
    logged = c.table("predictions").first()
    assert json.loads(logged.probabilities) == found["probabilities"] and logged.model_run_id == good.id
    assert [(r.kind, r.id) for r in c.history(project).collect()] == [("run", bad.id), ("run", good.id), ("prediction", 1)]
    with pytest.raises(ValueError):
        tuning.predict_one(spark, pipeline, {"x": 1.0})


@pytest.mark.parametrize("n", [1, 2, 3, 4, 11, 50_001])
def test_quantiles_between_places(spark, n):
    x = np.random.default_rng(n).normal(size=n).round(2)
    values = spark.createDataFrame([(float(a),) for a in x], "v double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert profile.quantile(values, q) == pytest.approx(np.quantile(x, q), abs=1e-12)
    assert profile.quantile(values.where("false"), 0.5) is None


@pytest.mark.parametrize("key,params", [("svc", {"kernel": "rbf"}), ("svc", {"kernel": "poly"}), ("dbscan", {"radius": 0.4}), ("kmeans", {}), ("ada_boost", {"estimators": 3})])
def test_every_kind_of_model_can_be_stored(spark, blobs, tmp_path, key, params):
    p = tuning.fit(blobs, ["x", "y"], key, params)
    tuning.save(p, f"{tmp_path}/m")
    again = tuning.load(spark, f"{tmp_path}/m")
    want = sorted(map(tuple, tuning.predict_rows(p, blobs).collect()))
    assert len({w[1] for w in want}) > 1 and sorted(map(tuple, tuning.predict_rows(again, blobs).collect())) == want


def test_scoring_is_a_map(blobs):
    """No shuffle, and the columns come back as they were given."""
    p = tuning.fit(blobs, ["x", "y"], "naive_bayes")
    given = blobs.withColumn("note", F.lit("n")).drop("row_idx")
    out = p.transform(given)
    assert out.columns == [*given.columns, "prediction", "probability"]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.select(*given.columns).collect())) == sorted(map(tuple, given.collect()))


def test_grid_and_ranking():
    assert tuning.grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    t = [{"n": 1, "score": None}, {"n": 2, "score": 0.5}, {"n": 3, "score": 0.9}, {"n": 4, "score": 0.5}]
    assert [x["n"] for x in tuning.rank_trials(t, "accuracy")] == [3, 2, 4, 1] and [x["n"] for x in tuning.rank_trials(t, "rmse")] == [2, 4, 3, 1]
    assert export.summary([{"metrics": {}}, {"metrics": {"accuracy": 0.2}}], "classification")["best"]["metrics"] == {"accuracy": 0.2}


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    with open(path, "w") as f:
        f.write("a,b c,y\n" + "".join(f"{i},{'' if i % 3 == 0 else 'x'},{i * 2}\n" for i in range(500)))
    df = tables.read_csv(spark, path)
    got = df.orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(500)) and [r.a for r in got] == [str(i) for i in range(500)] and got[0]["b c"] == ""
    assert tables.labeled_csv(spark, path).columns == ["row_idx", "a", "b c", "label"] and tables.sample(df, 3).count() == 3
    assert tables.check_upload(path) == "csv"
    for bad in (lambda: tables.check_upload("x.exe", 1), lambda: tables.check_upload("x.csv", 10**9), lambda: tables.from_rows(spark, [[1], [1, 2]])):
        with pytest.raises(ValueError):
            bad()
    many = f"{tmp_path}/many"
    spark.range(1000).selectExpr("cast(id as string) s").repartition(7).write.option("header", True).csv(many)
    assert sorted(r.row_idx for r in tables.read_csv(spark, many).collect()) == list(range(1000))


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    a = c.insert("datasets", name="one", rows=3)
    b = c.insert("datasets", name="two")
    c.update("datasets", a, name="uno")
    assert c.find("datasets", a)["name"] == "uno" and [r.id for r in c.listing("datasets").collect()] == [b, a]
    c.delete_dataset(b)
    assert c.find("datasets", b) is None and c.table("projects").count() == 0
    with pytest.raises(ValueError):
        c.insert("projects", status="odd")
    with pytest.raises(ValueError):
        c.insert("projects", unknown=1)
    assert [c.log_prediction(project_id=1, prediction=p) for p in "xyz"] == [1, 2, 3]
    assert [(r.id, r.prediction) for r in c.listing("predictions").collect()] == [(3, "z"), (2, "y"), (1, "x")]
    assert all(r.created_at for r in c.table("predictions").collect())
    with pytest.raises(ValueError):
        c.delete("predictions", 1)
    assert validate({"name": "", "kind": "z", "n": "1x"}, {"name": "required", "kind": "in_list[a,b]", "n": "integer", "free": "max_length[3]"}) == {"name": "name is required", "kind": "kind is none of a,b", "n": "n is not an integer"}


def test_client_code():
    code = export.client_code("python", "/m", ["a b"])
    compile(code, "client", "exec")
    with pytest.raises(ValueError):
        export.client_code("cobol", "/m", [])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 1001])
def test_column_quantiles_equal_exact_ones(spark, n):
    from lattice.operators import stages

    v = np.random.default_rng(n).normal(size=(n, 2)).round(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in v.tolist()] + [(None, float("nan"))], "a double, b double")
    got = stages.quantiles(df, ["a", "b"], [0.25, 0.5, 0.75])
    for k, c in enumerate("ab"):
        assert np.allclose([got[c][q] for q in (0.25, 0.5, 0.75)], np.quantile(v[:, k], [0.25, 0.5, 0.75]))


def test_column_quantiles_without_values(spark):
    from lattice.operators import stages

    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert stages.quantiles(df, ["a", "b"], [0.5]) == {"a": {0.5: None}, "b": {0.5: 1.0}}
    assert stages.quantiles(df.where("b > 1"), ["a"], [0.5]) == {"a": {0.5: None}}
