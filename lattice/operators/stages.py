"""Feature engineering: each stage is fitted to statistics of the table and applied as column expressions.

A fitted stage holds numbers and names only, so it can be stored as JSON and applied to a stream.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import float_value, is_missing, is_numeric
from . import linalg
from .matrix import Matrix
from .profile import at_places


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def quantiles(df: DataFrame, names: list[str], shares: list[float]) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of numeric columns, between the two nearest values by share; blanks and NaN are left out.

    No column is gathered: see at_places. A column without numbers has none.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), _c(c).cast("double").alias("v")) for c in names]))
    values = df.select(cells.alias("c")).select("c.*").where("v IS NOT NULL AND NOT isnan(v)")
    counts = {r.name: r.n for r in values.groupBy("name").agg(F.count("*").alias("n")).collect()}
    place = lambda q: F.lit(q) * (F.col("n") - F.lit(1))
    places = {f"{side}{k}": (q, f(place(q))) for k, q in enumerate(shares) for side, f in (("a", F.floor), ("b", F.ceil))}
    # A place differs from its share of n by less than two.
    found = {(r.name, r.q): r.v for r in at_places(values, places, max(0.0005, 2.0 / min(counts.values()))).collect()} if counts else {}

    def between(c: str, k: int, q: float) -> float | None:
        if c not in counts:
            return None
        a, b, at = found[c, f"a{k}"], found[c, f"b{k}"], q * (counts[c] - 1)
        return a + (at - np.floor(at)) * (b - a)

    return {c: {q: between(c, k, q) for k, q in enumerate(shares)} for c in names}


@dataclass
class Stage:
    """columns: those it works on, in order; None until fitted where it takes all numeric ones."""

    columns: list[str] | None = None
    keep: tuple[str, ...] = ("row_idx", "label")
    state: dict = field(default_factory=dict)

    def numeric(self, df: DataFrame) -> list[str]:
        kinds = dict(df.dtypes)
        return [c for c in (self.columns or df.columns) if c not in self.keep and (kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal"))]

    def textual(self, df: DataFrame) -> list[str]:
        kinds = dict(df.dtypes)
        return [c for c in (self.columns or df.columns) if c not in self.keep and kinds[c] == "string"]

    def fit(self, df: DataFrame) -> Stage:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def replaced(self, df: DataFrame, made: dict[str, list[Column] | Column]) -> DataFrame:
        out: list[Column] = []
        for c in df.columns:
            new = made.get(c, _c(c))
            out += [x.alias(c) for x in [new]] if isinstance(new, Column) else new
        return df.select(*out)


class NumericConvert(Stage):
    """Text columns whose cells are all numbers or missing become doubles."""

    def fit(self, df: DataFrame) -> Stage:
        names = self.textual(df)
        if names:
            row = df.agg(*[F.bool_and(is_missing(_c(c)) | is_numeric(_c(c)) | (_c(c) == "?")).alias(f"c{i}") for i, c in enumerate(names)], *[F.count_if(is_numeric(_c(c))).alias(f"n{i}") for i, c in enumerate(names)]).first()
            self.state["names"] = [c for i, c in enumerate(names) if row[f"c{i}"] and row[f"n{i}"]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.replaced(df, {c: F.when(is_numeric(_c(c)), float_value(_c(c))).otherwise(F.lit(float("nan"))) for c in self.state.get("names", []) if c in df.columns})


class Imputer(Stage):
    """Missing numbers (null, NaN) get the mean or median; missing text (null, '', '?') the most frequent value, first seen on ties."""

    def __init__(self, strategy: str = "mean", order: str = "row_idx", **kw):
        super().__init__(**kw)
        if strategy not in ("mean", "median"):
            raise ValueError(f"strategy {strategy}")
        self.strategy, self.order = strategy, order

    def fit(self, df: DataFrame) -> Stage:
        numbers, texts = self.numeric(df), self.textual(df)
        self.state = {"numbers": {}, "texts": {}}
        if numbers and self.strategy == "mean":
            row = df.agg(*[F.avg(F.when(~F.isnan(_c(c).cast("double")), _c(c).cast("double"))).alias(f"c{i}") for i, c in enumerate(numbers)]).first()
            found = {c: row[f"c{i}"] for i, c in enumerate(numbers)}
        else:
            found = {c: x[0.5] for c, x in quantiles(df, numbers, [0.5]).items()} if numbers else {}
        self.state["numbers"] = {c: 0.0 if v is None else float(v) for c, v in found.items()}
        for c in texts:
            place = _c(self.order) if self.order in df.columns else F.lit(0)
            top = df.where(~is_missing(_c(c)) & (_c(c) != "?")).groupBy(_c(c).alias("x")).agg(F.count("*").alias("n"), F.min(place).alias("first")).orderBy(F.desc("n"), "first", "x").first()
            self.state["texts"][c] = top.x if top else "?"
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        made = {c: F.when(_c(c).isNull() | F.isnan(_c(c).cast("double")), F.lit(v)).otherwise(_c(c).cast("double")) for c, v in self.state["numbers"].items()}
        made |= {c: F.when(is_missing(_c(c)) | (_c(c) == "?"), F.lit(v)).otherwise(_c(c)) for c, v in self.state["texts"].items()}
        return self.replaced(df, made)


class OneHot(Stage):
    """Each text column becomes an indicator for each of its values (sorted), none left out; unseen values give zeros."""

    LIMIT = 10_000

    def fit(self, df: DataFrame) -> Stage:
        self.state["values"] = {}
        for c in self.textual(df):
            rows = df.select(_c(c).alias("x")).distinct().orderBy("x").limit(self.LIMIT + 1).collect()
            if len(rows) > self.LIMIT:
                raise ValueError(f"{c} has more than {self.LIMIT} values")
            self.state["values"][c] = [r.x for r in rows if r.x is not None]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.replaced(df, {c: [F.when(_c(c) == v, 1.0).otherwise(0.0).alias(f"{c}={v}") for v in vs] for c, vs in self.state["values"].items()})


class Scale(Stage):
    """method z_scale: (x - mean) / population deviation; min_max: to 0..1; robust: (x - median) / IQR. No spread gives 0."""

    def __init__(self, method: str = "z_scale", **kw):
        super().__init__(**kw)
        if method not in ("z_scale", "min_max", "robust"):
            raise ValueError(f"scaler {method}")
        self.method = method

    def fit(self, df: DataFrame) -> Stage:
        names = self.numeric(df)
        if not names:
            self.state["shift"] = {}
            return self

        if self.method == "robust":
            found = quantiles(df, names, [0.25, 0.5, 0.75])
            self.state["shift"] = {c: (None, None) if x[0.5] is None else (float(x[0.5]), float(x[0.75] - x[0.25])) for c, x in found.items()}
            return self

        def pair(c: str) -> tuple[Column, Column]:
            x = _c(c).cast("double")
            return (F.avg(x), F.stddev_pop(x)) if self.method == "z_scale" else (F.min(x), F.max(x) - F.min(x))

        row = df.agg(*[p.alias(f"{k}{i}") for i, c in enumerate(names) for k, p in zip("ab", pair(c), strict=True)]).first()
        self.state["shift"] = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(names)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c: str, a: float | None, b: float | None) -> Column:
            return F.lit(0.0) if not b else (_c(c).cast("double") - F.lit(a)) / F.lit(b)

        return self.replaced(df, {c: scaled(c, a, b) for c, (a, b) in self.state["shift"].items()})


class VarianceFilter(Stage):
    """Drops numeric columns whose population variance is not above the threshold."""

    def __init__(self, threshold: float = 0.0, **kw):
        super().__init__(**kw)
        self.threshold = threshold

    def fit(self, df: DataFrame) -> Stage:
        names = self.numeric(df)
        row = df.agg(*[F.var_pop(_c(c)).alias(f"v{i}") for i, c in enumerate(names)]).first() if names else {}
        self.state["drop"] = [c for i, c in enumerate(names) if not (row[f"v{i}"] is not None and row[f"v{i}"] > self.threshold)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.state["drop"])


def _linear(df: DataFrame, names: list[str], centre: list[float], weights: list[list[float]], keep: tuple[str, ...], prefix: str) -> DataFrame:
    """df with the named columns replaced by weighted sums of the centred ones."""
    v = F.array(*[_c(c).cast("double") - F.lit(m) for c, m in zip(names, centre, strict=True)])
    made = [F.aggregate(F.zip_with(F.col("_v"), F.array(*[F.lit(w) for w in ws]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias(f"{prefix}{k}") for k, ws in enumerate(weights)]
    return df.withColumn("_v", v).select(*[_c(c) for c in df.columns if c not in names], *made)


def moments(df: DataFrame, names: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, covariance sums / rows) of numeric columns, in one pass."""
    v = F.array(F.lit(1.0), *[_c(c).cast("double") for c in names])
    g = Matrix(df.select(F.lit(0).cast("long").alias("row_id"), v.alias("v")), n=len(names) + 1).gram().local()
    n = g[0, 0] if len(g) else 0.0
    mean = g[0, 1:] / max(n, 1)
    return n, mean, g[1:, 1:] / max(n, 1) - np.outer(mean, mean)


class Pca(Stage):
    """The k directions of most variance, signed by their largest loading."""

    def __init__(self, k: int, **kw):
        super().__init__(**kw)
        self.k = k

    def fit(self, df: DataFrame) -> Stage:
        names = self.numeric(df)
        _, mean, covariance = moments(df, names)
        found = linalg.eig(covariance, True)
        self.state = {"names": names, "mean": mean.tolist(), "weights": found["vectors"][:, ::-1][:, : self.k].T.tolist(), "variance": found["values"][::-1][: self.k].tolist()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return _linear(df, self.state["names"], self.state["mean"], self.state["weights"], self.keep, "pc")


class TruncatedSvd(Pca):
    """Like Pca, without centring."""

    def fit(self, df: DataFrame) -> Stage:
        names = self.numeric(df)
        x = Matrix(df.select(F.lit(0).cast("long").alias("row_id"), F.array(*[_c(c).cast("double") for c in names]).alias("v")), n=len(names))
        _, vectors = linalg.truncated_svd(x, self.k)
        self.state = {"names": names, "mean": [0.0] * len(names), "weights": vectors.T.tolist()}
        return self


class LinearDiscriminants(Stage):
    """The k directions that part the label's classes best: between-class against within-class scatter."""

    def __init__(self, k: int, label: str = "label", **kw):
        super().__init__(**kw)
        self.k, self.label = k, label

    def fit(self, df: DataFrame) -> Stage:
        names = self.numeric(df)
        n, mean, total = moments(df, names)
        means = df.groupBy(_c(self.label)).agg(F.count("*").alias("_n"), *[F.avg(_c(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).collect()
        between = sum(r._n / n * np.outer(d, d) for r in means for d in [np.array([r[f"m{i}"] for i in range(len(names))]) - mean])
        within = total - between + 1e-9 * np.eye(len(names))
        root = linalg.inverse(linalg.cholesky(within))
        found = linalg.eig(root @ between @ root.T, True)
        weights = (root.T @ found["vectors"])[:, ::-1][:, : self.k]
        weights = weights / np.linalg.norm(weights, axis=0)
        weights *= np.where(weights[np.abs(weights).argmax(axis=0), np.arange(weights.shape[1])] < 0, -1, 1)
        self.state = {"names": names, "mean": mean.tolist(), "weights": weights.T.tolist()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return _linear(df, self.state["names"], self.state["mean"], self.state["weights"], self.keep, "ld")


class Polynomial(Stage):
    """Powers 1 to degree of each numeric column; interactions adds the products of pairs of columns."""

    def __init__(self, degree: int = 2, interactions: bool = False, **kw):
        super().__init__(**kw)
        self.degree, self.interactions = degree, interactions

    def fit(self, df: DataFrame) -> Stage:
        self.state["names"] = self.numeric(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        names = self.state["names"]
        x = {c: _c(c).cast("double") for c in names}
        made = {c: [x[c].alias(c), *[F.pow(x[c], F.lit(float(d))).alias(f"{c}^{d}") for d in range(2, self.degree + 1)]] for c in names}
        out = self.replaced(df, made)
        if self.interactions:
            out = out.select("*", *[(_c(a) * _c(b)).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i + 1 :]])
        return out


STAGES: dict[str, type[Stage]] = {
    "numeric_convert": NumericConvert, "imputer": Imputer, "one_hot": OneHot, "z_scale": Scale, "min_max": Scale, "robust": Scale,
    "variance_filter": VarianceFilter, "pca": Pca, "polynomial": Polynomial, "lda": LinearDiscriminants, "truncated_svd": TruncatedSvd,
}
DEFAULTS = {"scaler": "z_scale", "imputer": "mean", "one_hot": True, "variance_threshold": 0, "pca_components": None, "polynomial_degree": 1, "train_ratio": 0.8, "cv_folds": 5, "features": [], "drop_columns": []}


def build_stages(config: dict | None = None) -> list[Stage]:
    """In the fixed order: numbers, missing cells, indicators, scale, variance, components, powers."""
    c = DEFAULTS | (config or {})
    out: list[Stage] = [NumericConvert()]
    if c["imputer"] and c["imputer"] != "none":
        out.append(Imputer(c["imputer"] if c["imputer"] in ("mean", "median") else "mean"))
    if c["one_hot"]:
        out.append(OneHot())
    out.append(Scale(c["scaler"] if c["scaler"] in ("min_max", "robust") else "z_scale"))
    if c["variance_threshold"]:
        out.append(VarianceFilter(float(c["variance_threshold"])))
    if c["pca_components"]:
        out.append(Pca(int(c["pca_components"])))
    if c.get("lda_components"):
        out.append(LinearDiscriminants(int(c["lda_components"])))
    if int(c["polynomial_degree"]) > 1:
        out.append(Polynomial(int(c["polynomial_degree"])))
    return out


def fit_stages(stages: list[Stage], df: DataFrame) -> DataFrame:
    """Fits each stage to what the ones before make of df; returns what the last makes."""
    for s in stages:
        df = s.fit(df).transform(df)
    return df


def apply_stages(stages: list[Stage], df: DataFrame) -> DataFrame:
    for s in stages:
        df = s.transform(df)
    return df


def to_json(stages: list[Stage]) -> str:
    own = lambda s: {k: v for k, v in vars(s).items() if k not in ("state", "columns", "keep")}
    return json.dumps([{"stage": type(s).__name__, "args": own(s), "columns": s.columns, "keep": s.keep, "state": s.state} for s in stages])


def from_json(text: str) -> list[Stage]:
    kinds = {k.__name__: k for k in STAGES.values()}
    out = []
    for x in json.loads(text):
        s = kinds[x["stage"]](**x["args"], columns=x["columns"], keep=tuple(x["keep"]))
        s.state = x["state"]
        out.append(s)
    return out
