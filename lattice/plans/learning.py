"""Queries over feature stages, splits, metrics, estimators and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, estimators, export, metrics, stages, tuning
from .base import CELLS, Book, table, tidy

BOOK = Book()

# -- stages

_KEYS = ["l_orderkey", "l_linenumber"]
_X = ["l_quantity", "l_extendedprice", "l_discount"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEYS, *_X)


def _scale(method: str):
    def query(spark, sf_dir):
        df = _lines(spark, sf_dir)
        out = stages.Scale(method, columns=_X).fit(df).transform(df)
        return out.select(*_KEYS, *[tidy(c, 5).alias(c) for c in _X])

    return query


def _scale_sql(a: str, b: str) -> str:
    made = ", ".join(f"CASE WHEN {b.format(c)} = 0 THEN 0.0 ELSE round(({c} - {a.format(c)}) / {b.format(c)}, 5) + 0.0 END AS {c}" for c in _X)
    return f"WITH s AS (SELECT {', '.join(f'{f}({c}) AS {n}_{c}' for c in _X for f, n in (('avg', 'avg'), ('stddev_pop', 'sd'), ('min', 'lo'), ('max', 'hi'), ('median', 'med')))}, {', '.join(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr_{c}' for c in _X)} FROM lineitem) SELECT l_orderkey, l_linenumber, {made} FROM lineitem, s"


BOOK["scale_z"] = (_scale("z_scale"), _scale_sql("avg_{}", "sd_{}"))
BOOK["scale_minmax"] = (_scale("min_max"), _scale_sql("lo_{}", "(hi_{0} - lo_{0})"))
BOOK["scale_robust"] = (_scale("robust"), _scale_sql("med_{}", "iqr_{}"))


@BOOK.add("one_hot", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s{i}" for i, s in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])) + " FROM customer")
def one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    out = stages.OneHot(columns=["c_mktsegment"]).fit(df).transform(df)
    return out.toDF("c_custkey", *[f"s{i}" for i in range(len(out.columns) - 1)])


def _holes(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("row_idx"), F.when(k % 5 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("x"), F.when(k % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("s"))


def _impute_sql(f: str) -> str:
    return f"WITH t AS (SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS x, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer), m AS (SELECT {f}(x) AS m FROM t), p AS (SELECT s AS top FROM t WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, min(row_idx) LIMIT 1) SELECT row_idx, round(coalesce(x, m), 5) AS x, coalesce(s, top) AS s FROM t, m, p"


def _impute(strategy: str):
    def query(spark, sf_dir):
        df = _holes(spark, sf_dir)
        return stages.Imputer(strategy).fit(df).transform(df).withColumn("x", F.round("x", 5))

    return query


BOOK["impute_mean"] = (_impute("mean"), _impute_sql("avg"))
BOOK["impute_median"] = (_impute("median"), _impute_sql("median"))


@BOOK.add("numeric_convert", "SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 6 = 0 THEN -1.0 ELSE CAST(o_custkey AS DOUBLE) END AS a, o_orderstatus AS b FROM orders")
def numeric_convert(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("a"), F.col("o_orderstatus").alias("b"))
    out = stages.NumericConvert().fit(df).transform(df)
    return out.withColumn("a", F.when(F.isnan("a"), -1.0).otherwise(F.col("a")))


@BOOK.add("variance_filter", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def variance_filter(spark, sf_dir):
    df = _lines(spark, sf_dir)
    return stages.VarianceFilter(1.0, columns=_X).fit(df).transform(df)


@BOOK.add("polynomial", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, power(p_size, 2)::DOUBLE AS b, power(p_size, 3)::DOUBLE AS c FROM part")
def polynomial(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return stages.Polynomial(3, columns=["p_size"]).fit(df).transform(df).toDF("p_partkey", "a", "b", "c")


@BOOK.add("polynomial_interactions", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, power(p_size, 2)::DOUBLE AS b, p_retailprice AS c, round(power(p_retailprice, 2), 4) AS d, round(p_size * p_retailprice, 4) AS e FROM part")
def polynomial_interactions(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    out = stages.Polynomial(2, True, columns=["p_size", "p_retailprice"]).fit(df).transform(df).toDF("p_partkey", "a", "b", "c", "d", "e")
    return out.select("p_partkey", "a", "b", "c", F.round("d", 4).alias("d"), F.round("e", 4).alias("e"))


#: Components of an embedding.
WIDTH = 64


NAMES = [f"x{i}" for i in range(WIDTH)]


def _features(spark, sf_dir, n: int = WIDTH):
    e = table(spark, sf_dir, "embeddings")
    d = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("row_idx"), *[F.get(d, F.lit(i)).alias(f"x{i}") for i in range(n)], F.col("label").cast("string").alias("label"))


_PCA = f"""WITH e AS {CELLS}, m AS (SELECT i, j, x - avg(x) OVER (PARTITION BY j) AS x FROM e), c AS (SELECT a.j AS j, b.j AS k, sum(a.x * b.x) / (SELECT count(*) FROM embeddings) AS x FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j)
SELECT round(sum(x) FILTER (WHERE j = k), 5) AS total, round(sum(x * x), 5) AS squares, 0.0::DOUBLE AS covariance FROM c"""


@BOOK.add("pca", _PCA)
def pca(spark, sf_dir):
    """All components: their variances are the covariance's eigenvalues, so their sum and sum of squares are its; the first two don't vary together."""
    df = _features(spark, sf_dir)
    out = stages.Pca(WIDTH).fit(df).transform(df)
    row = out.agg(*[F.var_pop(f"pc{k}").alias(f"v{k}") for k in range(WIDTH)], F.covar_pop("pc0", "pc1").alias("c"))
    v = F.array(*[f"v{k}" for k in range(WIDTH)])
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    return row.select(F.round(add(v), 5).alias("total"), F.round(add(F.transform(v, lambda y: y * y)), 5).alias("squares"), tidy("c").alias("covariance"))


@BOOK.add("linear_discriminants")
def linear_discriminants(spark, sf_dir):
    df = _features(spark, sf_dir)
    return stages.LinearDiscriminants(2).fit(df).transform(df)


@BOOK.add("svd_projection")
def svd_projection(spark, sf_dir):
    df = _features(spark, sf_dir)
    return stages.TruncatedSvd(2).fit(df).transform(df)


_CHAIN = """WITH t AS (SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS x, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer),
p AS (SELECT s AS top FROM t WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, min(row_idx) LIMIT 1),
u AS (SELECT row_idx, coalesce(x, avg(x) OVER ()) AS x, CASE WHEN coalesce(s, top) = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM t, p)
SELECT row_idx, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 5) + 0.0 AS x, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 5) + 0.0 AS building FROM u"""


@BOOK.add("stage_chain", _CHAIN)
def stage_chain(spark, sf_dir):
    df = _holes(spark, sf_dir)
    made = stages.fit_stages(stages.build_stages(), df)
    return made.select("row_idx", tidy("x", 5).alias("x"), tidy("`s=BUILDING`", 5).alias("building"))


# -- splits and folds


@BOOK.add("kfold_assign", "SELECT row_idx, CASE WHEN row_idx // size < 5 THEN CAST(row_idx // size AS INTEGER) END AS fold FROM (SELECT vec_id AS row_idx, (SELECT count(*) // 5 FROM embeddings) AS size FROM embeddings)")
def kfold_assign(spark, sf_dir):
    return dataset.fold(_features(spark, sf_dir).select("row_idx"), 5)


@BOOK.add("strat_split", "SELECT vec_id AS row_idx, k <= floor(0.8 * n) AS train FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 37) % 1009, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def strat_split(spark, sf_dir):
    train, test = dataset.stratified_split(_features(spark, sf_dir), order=(F.col("row_idx") * 37) % 1009)
    return train.select("row_idx", F.lit(True).alias("train")).union(test.select("row_idx", F.lit(False).alias("train")))


@BOOK.add("strat_split_hashed", "SELECT CAST(label AS VARCHAR) AS label, CAST(floor(0.8 * count(*)) AS BIGINT) AS train, count(*) AS n FROM embeddings GROUP BY 1")
def strat_split_hashed(spark, sf_dir):
    train, test = dataset.stratified_split(_features(spark, sf_dir), seed=7)
    both = train.select("label", F.lit(1).alias("t")).union(test.select("label", F.lit(0).alias("t")))
    return both.groupBy("label").agg(F.sum("t").alias("train"), F.count("*").alias("n"))


@BOOK.add("train_complement", "SELECT vec_id AS row_idx FROM embeddings WHERE vec_id // (SELECT count(*) // 5 FROM embeddings) <> 2")
def train_complement(spark, sf_dir):
    return dataset.train_and_validation(dataset.fold(_features(spark, sf_dir).select("row_idx"), 5), 2)[0].select("row_idx")


# -- metrics

_TWO = "(SELECT CAST(quality AS VARCHAR) AS a, CAST(toxic AS VARCHAR) AS p FROM labels)"
_MANY = "(SELECT o_orderpriority AS a, CASE WHEN o_totalprice < 100000 THEN '1-URGENT' WHEN o_totalprice < 200000 THEN '2-HIGH' WHEN o_totalprice < 300000 THEN '3-MEDIUM' ELSE '5-LOW' END AS p FROM orders)"


def _two(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))


def _many(spark, sf_dir):
    t = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("actual"), F.when(t < 100000, "1-URGENT").when(t < 200000, "2-HIGH").when(t < 300000, "3-MEDIUM").otherwise("5-LOW").alias("predicted"))


def _class_sql(s: str) -> str:
    return f"""c AS (SELECT a AS class FROM {s} UNION SELECT p FROM {s}), k AS (SELECT class, (SELECT count(*) FROM {s} WHERE a = class AND p = class) AS tp, (SELECT count(*) FROM {s} WHERE p = class) AS said, (SELECT count(*) FROM {s} WHERE a = class) AS support FROM c),
m AS (SELECT class, coalesce(tp / nullif(said, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS re, support FROM k), x AS (SELECT class, round(pr, 4) AS precision, round(re, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4) AS f1, support FROM m)"""


for _n, _q, _s in (("binary", _two, _TWO), ("multi", _many, _MANY)):
    BOOK[f"accuracy_{_n}"] = (lambda spark, sf_dir, q=_q: metrics.accuracy(q(spark, sf_dir)), f"SELECT round(avg(CASE WHEN a = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy FROM {_s}")
    BOOK[f"per_class_{_n}"] = (lambda spark, sf_dir, q=_q: metrics.per_class(q(spark, sf_dir)), f"WITH {_class_sql(_s)} SELECT * FROM x")
    BOOK[f"macro_{_n}"] = (lambda spark, sf_dir, q=_q: metrics.macro(q(spark, sf_dir)), f"WITH {_class_sql(_s)} SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM x")
    BOOK[f"f_beta_{_n}"] = (lambda spark, sf_dir, q=_q: metrics.f_beta(q(spark, sf_dir), 2.0), f"WITH {_class_sql(_s)} SELECT round(avg(coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0)), 4) AS f_beta FROM x")
    BOOK[f"confusion_{_n}"] = (lambda spark, sf_dir, q=_q: metrics.confusion(q(spark, sf_dir)), f"WITH c AS (SELECT a AS class FROM {_s} UNION SELECT p FROM {_s}) SELECT x.class AS actual, y.class AS predicted, (SELECT count(*) FROM {_s} WHERE a = x.class AND p = y.class) AS n FROM c x, c y")
    BOOK[f"classes_{_n}"] = (lambda spark, sf_dir, q=_q: metrics.classes(q(spark, sf_dir)), f"SELECT a AS class FROM {_s} UNION SELECT p FROM {_s}")
BOOK["mcc_binary"] = (lambda spark, sf_dir: metrics.mcc(_two(spark, sf_dir)), f"WITH t AS (SELECT count(*) FILTER (WHERE a = '1' AND p = '1')::DOUBLE AS tp, count(*) FILTER (WHERE a = '0' AND p = '0')::DOUBLE AS tn, count(*) FILTER (WHERE a = '0' AND p = '1')::DOUBLE AS fp, count(*) FILTER (WHERE a = '1' AND p = '0')::DOUBLE AS fn FROM {_TWO}) SELECT round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 4) AS mcc FROM t")
BOOK["mcc_multi"] = (lambda spark, sf_dir: metrics.mcc(_many(spark, sf_dir)), f"WITH c AS (SELECT count(*)::DOUBLE AS k FROM (SELECT a FROM {_MANY} UNION SELECT p FROM {_MANY})), s AS (SELECT avg(CASE WHEN a = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM {_MANY}) SELECT round((acc - 1 / k) / (1 - 1 / k), 4) AS mcc FROM c, s")
BOOK["mcc_true"] = (lambda spark, sf_dir: metrics.mcc_multiclass(_many(spark, sf_dir)), f"WITH a AS (SELECT a AS c, count(*)::DOUBLE AS x FROM {_MANY} GROUP BY 1), p AS (SELECT p AS c, count(*)::DOUBLE AS y FROM {_MANY} GROUP BY 1), t AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN p USING (c)), u AS (SELECT sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x) AS s FROM t), h AS (SELECT count(*) FILTER (WHERE a = p)::DOUBLE AS c FROM {_MANY}) SELECT round((c * s - xy) / sqrt((s * s - yy) * (s * s - xx)), 4) AS mcc FROM u, h")


@BOOK.add("metrics_reg", "WITH t AS (SELECT l_extendedprice AS a, l_quantity * 1500 AS p FROM lineitem) SELECT round(sqrt(avg((a - p) * (a - p))), 4) AS rmse, round(avg(abs(a - p)), 4) AS mae, round(1 - avg((a - p) * (a - p)) / var_pop(a), 4) AS r2, round(avg((a - p) * (a - p)), 2) AS mse FROM t")
def metrics_reg(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500).alias("predicted"))
    return metrics.regression(df).withColumn("mse", F.round("mse", 2))


@BOOK.add("roc", "WITH t AS (SELECT toxic = 1 AS y, CAST(least(10, floor((doc_id % 97) / 97.0::DOUBLE * 10)) AS INTEGER) AS b FROM labels), h AS (SELECT k AS b, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM range(11) r(k) LEFT JOIN t ON t.b = k GROUP BY k) SELECT b / 10.0::DOUBLE AS threshold, round(sum(pos) OVER (ORDER BY b DESC) / nullif(sum(pos) OVER (), 0)::DOUBLE, 6) AS tpr, round(sum(neg) OVER (ORDER BY b DESC) / nullif(sum(neg) OVER (), 0)::DOUBLE, 6) AS fpr FROM h".replace("count(*) FILTER (WHERE NOT y)", "count(*) FILTER (WHERE y = false)"))
def roc(spark, sf_dir):
    return metrics.roc(table(spark, sf_dir, "labels"), F.col("toxic") == 1, (F.col("doc_id") % 97) / F.lit(97.0), 10)


# -- estimators with SQL

_KNN = f"""WITH q AS (SELECT i, j, x FROM {CELLS} WHERE i % 20 = 0), t AS (SELECT i AS t, j, x AS y FROM {CELLS}),
d AS (SELECT i, t, round(sqrt(sum((x - y) * (x - y))), 9) AS d FROM q JOIN t USING (j) GROUP BY i, t), n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, t) AS k FROM d)"""


@BOOK.add("knn", _KNN + ", v AS (SELECT n.i, label, count(*) AS c FROM n JOIN embeddings ON vec_id = t WHERE k <= 5 GROUP BY n.i, label) SELECT i AS row_idx, CAST(label AS VARCHAR) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, label) AS r FROM v) WHERE r = 1")
def knn(spark, sf_dir):
    df = _features(spark, sf_dir)
    model = estimators.ALGORITHMS["knn"].build({"k": 5}).fit(df, NAMES)
    return model.transform(df.where("row_idx % 20 = 0")).select("row_idx", "prediction")


@BOOK.add("knn_regressor", _KNN + ", v AS (SELECT n.i, avg(label) AS p FROM n JOIN embeddings ON vec_id = t WHERE k <= 5 GROUP BY n.i) SELECT i AS row_idx, round(p, 6) AS prediction FROM v")
def knn_regressor(spark, sf_dir):
    df = _features(spark, sf_dir)
    model = estimators.ALGORITHMS["knn_regressor"].build({"k": 5}).fit(df, NAMES)
    return model.transform(df.where("row_idx % 20 = 0")).select("row_idx", F.round("prediction", 6).alias("prediction"))


_BAYES = f"""WITH e AS (SELECT c.i, j, x, label FROM {CELLS} c JOIN embeddings ON vec_id = i), m AS (SELECT label, j, avg(x) AS m, greatest(var_pop(x), 1e-9) AS v FROM e GROUP BY label, j), p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM embeddings)::DOUBLE) AS p FROM embeddings GROUP BY label),
s AS (SELECT e.i, m.label, sum(-0.5 * ln(2 * pi() * v) - 0.5 * (x - m) * (x - m) / v) + any_value(p.p) AS s FROM e JOIN m USING (j) JOIN p ON p.label = m.label GROUP BY e.i, m.label),
b AS (SELECT i AS row_idx, CAST(label AS VARCHAR) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, label) AS r FROM s) WHERE r = 1)"""


@BOOK.add("gaussian_nb", _BAYES + " SELECT * FROM b")
def gaussian_nb(spark, sf_dir):
    df = _features(spark, sf_dir)
    return estimators.ALGORITHMS["naive_bayes"].build().fit(df, NAMES).transform(df).select("row_idx", "prediction")


@BOOK.add("ridge", "WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 5) AS w, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem) SELECT round(w, 4) AS weight, round(my - w * mx, 3) AS intercept FROM s")
def ridge(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    m = estimators.ALGORITHMS["ridge"].build({"alpha": 5.0}).fit(df, ["l_quantity"])
    return spark.createDataFrame([(round(m.weights[0], 4), round(m.intercept, 3))], "weight double, intercept double")


# -- estimators without

_SMALL = {
    "random_forest": {"estimators": 10, "max_depth": 5}, "svc": {"kernel": "linear"}, "ada_boost": {"estimators": 5}, "gradient_boost": {"estimators": 3}, "logistic_regression": {"epochs": 20},
    "decision_tree": {"max_depth": 5}, "lasso": {"alpha": 0.1}, "svr": {}, "gradient_boost_regressor": {"estimators": 5}, "regression_tree": {"max_depth": 5}, "kmeans": {"k": 4, "epochs": 20}, "dbscan": {"radius": 1.15}, "gaussian_mixture": {"k": 3, "epochs": 10},
}


def _fit_predict(key: str):
    def query(spark, sf_dir):
        df = _features(spark, sf_dir)
        if estimators.ALGORITHMS[key].kind == "regression":
            df = df.withColumn("label", F.col("x0") * 2 + F.col("x1"))
        names = NAMES
        return estimators.ALGORITHMS[key].build(_SMALL[key]).fit(df, names).transform(df).select("row_idx", "prediction")

    return query


_DBSCAN = f"""WITH RECURSIVE n AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a, embeddings b WHERE list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 1.15),
core AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 5), l AS (SELECT n.i, n.j FROM n JOIN core a ON a.i = n.i JOIN core b ON b.i = n.j),
r(i, root) AS (SELECT i, i FROM core UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.i),
c AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS p FROM (SELECT i, min(root) AS root FROM r GROUP BY i))
SELECT e.vec_id AS row_idx, CAST(coalesce(min(c.p), -1) AS INTEGER) AS prediction FROM embeddings e LEFT JOIN n ON n.i = e.vec_id LEFT JOIN c ON c.i = n.j GROUP BY 1"""

for _key in _SMALL:
    BOOK[f"ml_{_key}"] = (_fit_predict(_key), _DBSCAN if _key == "dbscan" else None)


@BOOK.add("ml_pipeline")
def ml_pipeline(spark, sf_dir):
    df = _features(spark, sf_dir)
    pipeline = tuning.fit(df, NAMES, "naive_bayes", config={"polynomial_degree": 2})
    return pipeline.transform(df).select("row_idx", "prediction")


@BOOK.add("cross_validation")
def cross_validation(spark, sf_dir):
    cv = tuning.cross_validate(_features(spark, sf_dir), NAMES, "naive_bayes", folds=3)
    return spark.createDataFrame([(k, s, cv["mean"], cv["std"]) for k, s in enumerate(cv["scores"])], "fold int, score double, mean double, std double")


@BOOK.add("grid_search")
def grid_search(spark, sf_dir):
    df = _features(spark, sf_dir).withColumn("label", F.col("x0") * 2 + F.col("x1"))
    found = tuning.search(df, NAMES, "ridge", {"alpha": [0.1, 1.0]}, metric="rmse", folds=2)
    return spark.createDataFrame([(str(t["params"]), t["score"], t["error"]) for t in found["trials"]], "params string, score double, error string")


@BOOK.add("random_search")
def random_search(spark, sf_dir):
    df = _features(spark, sf_dir).withColumn("label", F.col("x0") * 2 + F.col("x1"))
    found = tuning.search(df, NAMES, "ridge", {"alpha": [0.1, 1.0, 5.0, 10.0]}, "random", "rmse", 2, 2)
    return spark.createDataFrame([(str(t["params"]), t["score"], t["error"]) for t in found["trials"]], "params string, score double, error string")


@BOOK.add("learning_curve")
def learning_curve(spark, sf_dir):
    rows = tuning.learning_curve(_features(spark, sf_dir), NAMES, "naive_bayes", (0.5, 1.0))
    return spark.createDataFrame([(r["share"], r["accuracy"]) for r in rows], "share double, accuracy double")


@BOOK.add("select_features", "SELECT k AS place, 'x' || f AS feature FROM (SELECT row_number() OVER (ORDER BY f DESC) - 1 AS k, j AS f FROM (SELECT 1 AS f, 1 AS j)) WHERE false UNION ALL SELECT r - 1, 'x' || j FROM (SELECT j, row_number() OVER (ORDER BY b / w DESC, j) AS r FROM (SELECT g.j, sum(g.n * (g.m - t.m) * (g.m - t.m)) AS b, sum(g.n * g.v) AS w FROM (SELECT j, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM " + CELLS + " c JOIN embeddings ON vec_id = c.i GROUP BY j, label) g JOIN (SELECT j, avg(x) AS m FROM " + CELLS + " GROUP BY j) t USING (j) GROUP BY g.j)) WHERE r <= 2")
def select_features(spark, sf_dir):
    names = tuning.select_features(_features(spark, sf_dir), NAMES, 2)
    return spark.createDataFrame(list(enumerate(names)), "place long, feature string")


@BOOK.add("compare_algorithms")
def compare_algorithms(spark, sf_dir):
    runs = tuning.train_all(_features(spark, sf_dir), NAMES, [{"key": "naive_bayes"}, {"key": "knn"}, {"key": "nonsense"}], folds=2)
    best = tuning.best_run(runs, "classification")
    return spark.createDataFrame([(r.algorithm, r.status, float(r.metrics.get("accuracy", 0)), r is best) for r in runs], "algorithm string, status string, accuracy double, best boolean")


@BOOK.add("param_grid", "SELECT a, b FROM (VALUES (1), (2), (3)) t(a), (VALUES ('x'), ('y')) u(b)")
def param_grid(spark, sf_dir):
    return spark.createDataFrame([(g["a"], g["b"]) for g in tuning.grid({"a": [1, 2, 3], "b": ["x", "y"]})], "a int, b string")


@BOOK.add("best_run", "SELECT 'b' AS algorithm, 0.9::DOUBLE AS accuracy, 4 AS total")
def best_run(spark, sf_dir):
    runs = [tuning.Run(a, {}, s, {"accuracy": x}) for a, s, x in (("a", "completed", 0.5), ("b", "completed", 0.9), ("c", "completed", 0.9), ("d", "failed", 1.0))]
    best = tuning.best_run(runs, "classification")
    total = export.summary([{"algorithm": r.algorithm, "metrics": r.metrics} for r in runs], "classification")["total"]
    return spark.createDataFrame([(best.algorithm, best.metrics["accuracy"], total)], "algorithm string, accuracy double, total int")


@BOOK.add("rank_trials", "SELECT * FROM (VALUES (0, 'b'), (1, 'c'), (2, 'a'), (3, 'd')) t(place, name)")
def rank_trials(spark, sf_dir):
    trials = [{"name": n, "score": s} for n, s in (("a", 3.0), ("b", 1.0), ("d", None), ("c", 1.0))]
    return spark.createDataFrame([(i, t["name"]) for i, t in enumerate(tuning.rank_trials(trials, "rmse"))], "place int, name string")


@BOOK.add("cv_summary", "SELECT round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS std FROM (VALUES (0.5::DOUBLE), (0.75), (0.9)) t(s)")
def cv_summary(spark, sf_dir):
    s = metrics.scores_summary([0.5, 0.75, 0.9])
    return spark.createDataFrame([(s["mean"], s["std"])], "mean double, std double")


@BOOK.add("registry")
def registry(spark, sf_dir):
    return spark.createDataFrame([(k, v["type"], len(v["params"])) for k, v in estimators.describe().items()], "key string, type string, params int")


@BOOK.add("class_probabilities", _BAYES + ", x AS (SELECT i, label, exp(s - max(s) OVER (PARTITION BY i)) AS x FROM s) SELECT i AS row_idx, CAST(label AS VARCHAR) AS label, round(x / sum(x) OVER (PARTITION BY i), 6) + 0.0 AS probability FROM x")
def class_probabilities(spark, sf_dir):
    df = _features(spark, sf_dir)
    model = estimators.ALGORITHMS["naive_bayes"].build().fit(df, NAMES)
    both = F.arrays_zip(F.array(*[F.lit(c) for c in model.classes]).alias("label"), F.col("probability"))
    return model.transform(df).select("row_idx", F.explode(both).alias("x")).select("row_idx", F.col("x.label").alias("label"), tidy("x.probability").alias("probability"))


@BOOK.add("feature_importances", "SELECT 'l_quantity' AS feature, round(abs(covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 5)), 4) AS importance FROM lineitem")
def feature_importances(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    m = estimators.ALGORITHMS["ridge"].build({"alpha": 5.0}).fit(df, ["l_quantity"])
    return spark.createDataFrame([(k, round(v, 4)) for k, v in m.importances.items()], "feature string, importance double")


@BOOK.add("tree_importances")
def tree_importances(spark, sf_dir):
    df = _features(spark, sf_dir)
    m = estimators.ALGORITHMS["decision_tree"].build({"max_depth": 4}).fit(df, NAMES)
    return spark.createDataFrame(list(m.importances.items()), "feature string, importance double")


@BOOK.add("stage_registry", "SELECT * FROM (VALUES ('imputer'), ('lda'), ('min_max'), ('numeric_convert'), ('one_hot'), ('pca'), ('polynomial'), ('robust'), ('truncated_svd'), ('variance_filter'), ('z_scale')) t(stage)")
def stage_registry(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in stages.STAGES], "stage string")


@BOOK.add("config_merge", "SELECT 'min_max' AS scaler, 'mean' AS imputer, 3::BIGINT AS polynomial_degree, 6::BIGINT AS stages")
def config_merge(spark, sf_dir):
    given = {"scaler": "min_max", "polynomial_degree": 3, "pca_components": 2}
    merged = stages.DEFAULTS | given
    return spark.createDataFrame([(merged["scaler"], merged["imputer"], merged["polynomial_degree"], len(stages.build_stages(given)))], "scaler string, imputer string, polynomial_degree long, stages long")


@BOOK.add("top_values", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
def top_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)


@BOOK.add("silhouette")
def silhouette(spark, sf_dir):
    df = _features(spark, sf_dir)
    found = tuning.evaluate(tuning.fit(df, NAMES, "kmeans", {"k": 3, "epochs": 20}), df)
    return spark.createDataFrame([(k, n, found["silhouette"]) for k, n in found["cluster_sizes"].items()], "cluster string, n long, silhouette double")
