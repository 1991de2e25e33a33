"""Metrics of predictions held beside the actual values in one table (actual, predicted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _texts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.select(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p"))


def class_order(name: str) -> list[Column]:
    """Numeric names by number, others after them by text."""
    return [F.col(name).try_cast("double").asc_nulls_last(), F.col(name).asc()]


def classes(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(class): the distinct union of actual and predicted, in order."""
    t = _texts(df, actual, predicted)
    return t.select(F.explode(F.array("a", "p")).alias("class")).distinct().orderBy(*class_order("class"))


def counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(a, p, n): the confusion counts that occur; all class metrics come from this small table."""
    return _texts(df, actual, predicted).groupBy("a", "p").agg(F.count("*").alias("n"))


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) for every pair of classes, zeros included."""
    n = counts(df, actual, predicted)
    every = n.select(F.explode(F.array("a", "p")).alias("class")).distinct()
    grid = every.select(F.col("class").alias("a")).crossJoin(F.broadcast(every.select(F.col("class").alias("p"))))
    return grid.join(n, ["a", "p"], "left").select(F.col("a").alias("actual"), F.col("p").alias("predicted"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return _texts(df, actual, predicted).agg(F.round(F.avg(F.when(F.col("a") == F.col("p"), 1.0).otherwise(0.0)), 4).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def per_class(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(class, precision, recall, f1, support), one class against the rest; 0 for a zero denominator."""
    n = counts(df, actual, predicted)
    cells = F.explode(F.array(F.struct(F.col("a").alias("class"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("said"), F.col("n").alias("there")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("said"), F.lit(0).cast("long").alias("there"))))
    t = n.select(cells.alias("c")).select("c.*").groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("said").alias("said"), F.sum("there").alias("support"))
    p, r = _ratio(F.col("tp"), F.col("said")), _ratio(F.col("tp"), F.col("support"))
    return t.select("class", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_ratio(F.lit(2.0) * p * r, p + r), 4).alias("f1"), "support")


def macro(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Means of the rounded class values."""
    return per_class(df, actual, predicted).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def f_beta(df: DataFrame, beta: float = 1.0, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """The macro F-beta, from the class values."""
    b = F.lit(beta * beta)
    p, r = F.col("precision"), F.col("recall")
    return per_class(df, actual, predicted).agg(F.round(F.avg(_ratio((1 + b) * p * r, b * p + r)), 4).alias("f_beta"))


def mcc(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Two classes: the exact coefficient, the second class positive. More: chance-corrected accuracy; one class: null."""
    n = counts(df, actual, predicted)
    every = n.select(F.explode(F.array("a", "p")).alias("class")).distinct()
    top = every.agg(F.count("*").alias("k"), F.max(F.struct(F.coalesce(F.col("class").try_cast("double"), F.lit(float("inf"))), "class"))["class"].alias("pos"))
    joined = n.crossJoin(F.broadcast(top))
    pos_a, pos_p = F.col("a") == F.col("pos"), F.col("p") == F.col("pos")
    cell = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("double")
    t = joined.groupBy("k").agg(cell(pos_a & pos_p).alias("tp"), cell(~pos_a & ~pos_p).alias("tn"), cell(~pos_a & pos_p).alias("fp"), cell(pos_a & ~pos_p).alias("fn"), (cell(F.col("a") == F.col("p")) / F.sum("n")).alias("acc"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    exact = F.coalesce((tp * tn - fp * fn) / F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0)), F.lit(0.0))
    chance = F.lit(1.0) / F.col("k")
    return t.select(F.round(F.when(F.col("k") == 1, None).when(F.col("k") == 2, exact).otherwise((F.col("acc") - chance) / F.nullif(1 - chance, F.lit(0.0))), 4).alias("mcc"))


def mcc_multiclass(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """The multiclass coefficient proper."""
    n = counts(df, actual, predicted)
    t = per_side = n.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))).alias("s")).select("s.*")
    t = per_side.groupBy("c").agg(F.sum("x").cast("double").alias("x"), F.sum("y").cast("double").alias("y"))
    sums = t.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("x").alias("s"))
    hit = n.agg(F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).cast("double").alias("c"))
    s = F.col("s") * F.col("s")
    return sums.crossJoin(F.broadcast(hit)).select(F.round(F.coalesce((F.col("c") * F.col("s") - F.col("xy")) / F.nullif(F.sqrt((s - F.col("yy")) * (s - F.col("xx"))), F.lit(0.0)), F.lit(0.0)), 4).alias("mcc"))


def regression(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """rmse, mae, r2, mse; r2 is 0 for constant actual values; no row for an empty table."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    t = df.agg(F.count("*").alias("n"), F.avg((a - p) * (a - p)).alias("mse"), F.avg(F.abs(a - p)).alias("mae"), F.var_pop(a).alias("v"))
    r2 = F.coalesce(1 - F.col("mse") / F.nullif(F.col("v"), F.lit(0.0)), F.lit(0.0))
    return t.where("n > 0").select(F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round(r2, 4).alias("r2"), F.round("mse", 4).alias("mse"))


def scores_summary(scores: list[float]) -> dict:
    """Mean and population deviation of the folds' scores."""
    n = len(scores)
    mean = sum(scores) / n if n else 0.0
    return {"mean": round(mean, 4), "std": round((sum((s - mean) ** 2 for s in scores) / n) ** 0.5, 4) if n else 0.0, "scores": [round(s, 4) for s in scores]}


def roc(df: DataFrame, positive: Column, score: Column, steps: int = 100) -> DataFrame:
    """(threshold, tpr, fpr) over equal steps of score from 0 to 1, from one histogram of the scores."""
    hist = df.groupBy(F.least(F.lit(steps), F.floor(score * steps)).cast("int").alias("b")).agg(F.sum(positive.cast("int")).alias("pos"), F.sum((~positive).cast("int")).alias("neg"))
    # steps + 1 rows in one window, whatever the table's size.
    frame = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("b")).join(hist, "b", "left").na.fill(0)
    down, every = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    tpr = _ratio(F.sum("pos").over(down), F.sum("pos").over(every))
    fpr = _ratio(F.sum("neg").over(down), F.sum("neg").over(every))
    return frame.select((F.col("b") / steps).alias("threshold"), F.round(tpr, 6).alias("tpr"), F.round(fpr, 6).alias("fpr"))


def auc(curve: DataFrame) -> float:
    """The area under a roc() table by trapezes."""
    rows = [(0.0, 0.0), *[(r.fpr, r.tpr) for r in curve.orderBy(F.desc("threshold")).collect()]]
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(rows, rows[1:], strict=False))
