"""Labeled and unlabeled datasets, splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import float_value, is_missing


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def build_dataset(df: DataFrame, features: list[str], target: str, kinds: dict[str, str], regression: bool = False, keep: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    """Typed features and label: missing numbers are NaN, other missing cells '?'; rows without a label go."""
    label = _c(target).cast("string")
    typed = [_feature(c, kinds[c], F.lit(float("nan")), "?", True) for c in features]
    label_out = float_value(label) if regression else label
    return df.where(~is_missing(label)).select(*[_c(k) for k in keep if k in df.columns], *typed, label_out.alias("label"))


def build_unlabeled(df: DataFrame, features: list[str], kinds: dict[str, str], keep: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    """Typed features: null numbers are 0 and other nulls '?'; a blank stays a blank."""
    return df.select(*[_c(k) for k in keep if k in df.columns], *[_feature(c, kinds[c], F.lit(0.0), "?", False) for c in features])


def _feature(name: str, kind: str, number: Column, text: str, blank_missing: bool) -> Column:
    cell = _c(name).cast("string")
    gone = is_missing(cell) if blank_missing else cell.isNull()
    if kind == "continuous":
        return F.when(gone, number).otherwise(float_value(cell)).alias(name)
    return F.when(gone, F.lit(text)).otherwise(cell).alias(name)


def non_missing(df: DataFrame, name: str) -> DataFrame:
    return df.where(~is_missing(_c(name).cast("string")))


def transform_labels(df: DataFrame, function) -> DataFrame:
    """The label column through a column function, such as float_value."""
    return df.withColumn("label", function(F.col("label")))


def feature_names(df: DataFrame, target: str, features: list[str] | None = None, drop: tuple[str, ...] = ()) -> list[str]:
    names = features or [c for c in df.columns if c not in (target, "row_idx")]
    return [c for c in names if c not in drop]


def stratified_split(df: DataFrame, ratio: float = 0.8, seed: int = 0, label: str = "label", key: str = "row_idx", order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each label, the first floor(ratio * n) rows in hash order (or `order`) train.

    The exact cut is found in two aggregations, without ranking a label's rows in one task: rows are counted by
    label and hash prefix, and only the prefix in which the cut falls is ranked.
    """
    h = order if order is not None else F.xxhash64(_c(key), F.lit(seed))
    marked = df.withColumn("_h", h).withColumn("_p", F.shiftright(F.col("_h"), 48) if order is None else F.lit(0).cast("long"))
    counts = marked.groupBy(_c(label).alias("_l"), "_p").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    cuts = counts.select("*", F.sum("_n").over(running).alias("_to"), F.floor(F.lit(ratio) * F.sum("_n").over(Window.partitionBy("_l"))).alias("_take"))
    cuts = cuts.where("_to - _n < _take AND _take <= _to").select("_l", F.col("_p").alias("_cut"), (F.col("_take") - F.col("_to") + F.col("_n")).alias("_left"))
    joined = marked.join(cuts, _c(label).eqNullSafe(cuts["_l"]), "left")
    at_cut = F.when(F.col("_p") == F.col("_cut"), F.row_number().over(Window.partitionBy(_c(label), "_p").orderBy("_h", _c(key))))
    train = F.coalesce((F.col("_p") < F.col("_cut")) | (at_cut <= F.col("_left")), F.lit(False))
    placed = joined.withColumn("_train", train)
    names = [_c(c) for c in df.columns]
    return placed.where("_train").select(*names), placed.where("NOT _train").select(*names)


def hash_split(df: DataFrame, ratio: float = 0.8, seed: int = 0, key: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """(train, test) by each row's own hash; needs no shuffle."""
    train = F.pmod(F.xxhash64(_c(key), F.lit(seed)), F.lit(1_000_000)) < int(ratio * 1_000_000)
    return df.where(train), df.where(~train)


def fold(df: DataFrame, k: int, n: int | None = None, index: str = "row_idx") -> DataFrame:
    """df with fold: contiguous runs of floor(n / k) rows by index; the rest of the rows belongs to no fold (null)."""
    size = max(1, (df.count() if n is None else n) // k)
    at = F.floor(_c(index) / F.lit(size)).cast("int")
    return df.withColumn("fold", F.when(at < k, at))


def train_and_validation(df: DataFrame, which: int) -> tuple[DataFrame, DataFrame]:
    """All rows but those of the fold, and those of the fold."""
    return df.where(F.col("fold").isNull() | (F.col("fold") != which)), df.where(F.col("fold") == which)
