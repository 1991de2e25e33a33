"""Exploratory profiles of record tables: kinds, counts, summaries, quantiles, histograms, correlations."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import float_value, is_missing, is_numeric

SAMPLE_ROWS, NUMERIC_SHARE, CATEGORIES, TOP, BINS = 100, 0.95, 20, 20, 10


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def long_form(df: DataFrame, names: list[str], order: str | None = "row_idx") -> DataFrame:
    """(name, x, o): a row for each cell of the named columns, x as text, o the row's place."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), _c(n).cast("string").alias("x")) for n in names]))
    place = _c(order) if order else F.lit(0).cast("long")
    return df.select(place.alias("o"), cells.alias("c")).select("c.name", "c.x", "o")


def kinds(df: DataFrame, names: list[str], order: str = "row_idx", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(name, kind): continuous, categorical, string or unknown, from the first rows only, blanks skipped."""
    first = df.orderBy(order).limit(rows)
    x = F.col("x")
    counted = long_form(first, names, order).groupBy("name").agg(
        F.count_if(~is_missing(x)).alias("n"), F.count_if(~is_missing(x) & is_numeric(x)).alias("numeric"), F.count_distinct(F.coalesce(x, F.lit(""))).alias("distinct")
    )
    kind = F.when(F.col("n") == 0, "unknown").when(F.col("numeric") >= NUMERIC_SHARE * F.col("n"), "continuous").when(F.col("distinct") <= CATEGORIES, "categorical").otherwise("string")
    return counted.select("name", kind.alias("kind"))


def kind_map(df: DataFrame, names: list[str] | None = None, order: str = "row_idx") -> dict[str, str]:
    """Kinds by column: numeric columns are continuous by type; text goes by its first rows."""
    names = names or [c for c in df.columns if c != order]
    types = dict(df.dtypes)
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double")
    found = {n: "continuous" for n in names if types[n] in plain or types[n].startswith("decimal")}
    if rest := [n for n in names if n not in found]:
        found |= {r.name: r.kind for r in kinds(df, rest, order).collect()}
        found |= {n: "unknown" for n in rest if n not in found}
    return {n: found[n] for n in names}


def task_type(kinds_: dict[str, str], target: str | None = None) -> tuple[str, str]:
    """(target, task): the last column by default; continuous ones make it regression."""
    target = target or list(kinds_)[-1]
    return target, "regression" if kinds_[target] == "continuous" else "classification"


def missing(df: DataFrame, names: list[str], order: str | None = None) -> DataFrame:
    """(name, n, missing, missing_pct, unique); blanks count as a value of their own."""
    x = F.col("x")
    out = long_form(df, names, order).groupBy("name").agg(F.count("*").alias("n"), F.count_if(is_missing(x)).alias("missing"), F.count_distinct(F.coalesce(x, F.lit(""))).alias("unique"))
    pct = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * F.col("missing") / F.col("n"), 2))
    return out.select("name", "n", "missing", pct.alias("missing_pct"), "unique")


def overall_missing(df: DataFrame, names: list[str]) -> DataFrame:
    """The mean of the columns' (rounded) missing shares."""
    return missing(df, names).agg(F.round(F.avg("missing_pct"), 2).alias("missing_pct"))


def _numbers(df: DataFrame, names: list[str], order: str | None = None) -> DataFrame:
    """(name, v): the numeric cells; numeric columns are taken as they are, text as the numbers it holds."""
    types = dict(df.dtypes)

    def value(c: str) -> Column:
        if types[c] != "string":
            x = _c(c).cast("double")
            return F.when(~F.isnan(x), x)
        return F.when(is_numeric(_c(c)), float_value(_c(c)))

    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), value(n).alias("v")) for n in names]))
    return df.select(cells.alias("c")).select("c.name", "c.v").where("v IS NOT NULL")


#: Up to so many values a name, all are put in order: places are too few for a bracket to hold them for sure.
SHORT = 20_000


def at_places(values: DataFrame, places: dict[str, tuple[float, Column]], near: float = 0.0005) -> DataFrame:
    """(name, q, v) of (name, v): for each label q, the element at a place (an expression in n) of each name's sorted values, exact.

    Approximate quantiles about the place's share of n (as far as near from it) bracket it; what lies below a bracket is counted, and only
    the values inside it, a thousandth of the data, are put in order. No name's values are gathered. The sketch errs by at
    most a 20,000th of the places, a tenth of near.
    """
    grid = sorted({max(0.0, min(1.0, s + d)) for s, _ in places.values() for d in (-near, near)})
    about = values.groupBy("name").agg(F.count("*").alias("n"), F.percentile_approx("v", grid, 20_000).alias("g"), F.min("v").alias("lo"), F.max("v").alias("hi"))

    def at(label: str, share: float, place: Column) -> Column:
        a, b = max(0.0, share - near), min(1.0, share + near)
        low = F.when(F.lit(a == 0.0) | (F.col("n") <= SHORT), F.col("lo")).otherwise(F.get("g", F.lit(grid.index(a))))
        high = F.when(F.lit(b == 1.0) | (F.col("n") <= SHORT), F.col("hi")).otherwise(F.get("g", F.lit(grid.index(b))))
        return F.struct(F.lit(label).alias("q"), low.alias("low"), high.alias("high"), F.least(place, F.col("n") - 1).alias("place"))

    brackets = about.select("name", F.explode(F.array(*[at(q, s, p) for q, (s, p) in places.items()])).alias("b")).select("name", "b.*")
    # A row for each name and label: as small as the table is wide.
    marked = values.join(F.broadcast(brackets), "name").where("v <= high")
    # All values below a bracket are one group (null, first in order); those inside are counted each.
    counted = marked.groupBy("name", "q", "place", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    running = Window.partitionBy("name", "q").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("c").over(running))
    return upto.where("v IS NOT NULL AND place >= upto - c AND place < upto").select("name", "q", "v")


def order_statistics(values: DataFrame, shares: list[float]) -> DataFrame:
    """(name, q, v): the element at place floor(n * share) of each name's sorted values."""
    found = at_places(values, {str(s): (s, F.floor(F.col("n") * F.lit(s))) for s in shares})
    return found.withColumn("q", F.col("q").cast("double"))


def quantile(values: DataFrame, q: float) -> float | None:
    """The quantile q of v, exact, linear between the two places it lies between; none for no values."""
    named = values.select(F.lit("").alias("name"), "v").where("v IS NOT NULL")
    at = (F.col("n") - 1) * F.lit(float(q))
    found = {r.q: r.v for r in at_places(named, {"low": (q, F.floor(at)), "high": (q, F.ceil(at))}).collect()}
    if not found or found["low"] == found["high"]:
        return found.get("low")
    share = (named.count() - 1) * q % 1
    return (1 - share) * found["low"] + share * found["high"]


def summary(df: DataFrame, names: list[str], order: str | None = None) -> DataFrame:
    """(name, n, min, max, mean, median, std, q25, q75, skewness) over numeric cells; columns without any are left out."""
    values = _numbers(df, names, order)
    m = F.avg("v")
    first = values.groupBy("name").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), m.alias("mean"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("skew"))
    n = F.col("n")
    places = {"q25": (0.25, F.floor(n * F.lit(0.25))), "q75": (0.75, F.floor(n * F.lit(0.75))), "m1": (0.5, F.floor((n - 1) / F.lit(2))), "m2": (0.5, F.floor(n / F.lit(2)))}
    found = at_places(values, places).groupBy("name").agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(q) for q in places])
    skew = F.when((F.col("n") < 3) | (F.col("std") == 0), 0.0).otherwise(F.coalesce(F.round("skew", 4), F.lit(0.0)))
    four = lambda c: F.round(c, 4).alias(c)
    found = found.withColumn("median", (F.col("m1") + F.col("m2")) / F.lit(2.0))
    return first.join(found, "name").select("name", "n", "min", "max", four("mean"), four("median"), four("std"), "q25", "q75", skew.alias("skewness"))


def histogram(df: DataFrame, names: list[str], bins: int = BINS, order: str | None = None) -> DataFrame:
    """(name, bin, edge, n): equal widths from min to max; empty bins are there; one value makes one bin."""
    values = _numbers(df, names, order)
    ends = values.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0)))))
    # One row a column is sent to all tasks.
    counted = values.join(F.broadcast(ends), "name").groupBy("name", place.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    last = F.when(F.col("hi") == F.col("lo"), 0).otherwise(bins - 1)
    frame = ends.select("name", "lo", "hi", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    return frame.join(counted, ["name", "bin"], "left").select("name", "bin", F.round(F.col("lo") + F.col("bin") * width, 3).alias("edge"), F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def value_counts(df: DataFrame, names: list[str], top: int = TOP, order: str = "row_idx") -> DataFrame:
    """(name, value, n): the most frequent values of each column, ties by first appearance; blanks left out."""
    cells = long_form(df, names, order).where(~is_missing(F.col("x")))
    counted = cells.groupBy("name", F.col("x").alias("value")).agg(F.count("*").alias("n"), F.min("o").alias("first"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "first", "value"))
    return counted.withColumn("place", rank).where(F.col("place") <= top).select("name", "value", "n", "place")


def pearson(x: Column, y: Column) -> Column:
    """0 for fewer than two rows or no variance."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(x) < 2, 0.0).otherwise(F.coalesce(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)))


def correlation(df: DataFrame, names: list[str], drop_blank: bool = False) -> DataFrame:
    """(a, b, r) for all ordered pairs of the columns, in one aggregation of the pairs a <= b.

    By default a blank counts as 0 and text as the number it starts with; drop_blank leaves such rows out of a pair.
    """
    pairs = list(combinations_with_replacement(names, 2))

    def value(c: str) -> Column:
        if dict(df.dtypes)[c] != "string":
            return F.coalesce(_c(c).cast("double"), F.lit(None if drop_blank else 0.0).cast("double"))
        number = float_value(_c(c))
        return F.when(is_numeric(_c(c)), number) if drop_blank else number

    wide = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(names)])

    def both(a: str, b: str) -> Column:
        x, y = F.col(f"c{names.index(a)}"), F.col(f"c{names.index(b)}")
        if drop_blank:
            x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return F.round(pearson(x, y), 4)

    row = wide.agg(*[both(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cell = lambda a, b, k: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r"))
    cells = [c for k, (a, b) in enumerate(pairs) for c in ([cell(a, b, k)] if a == b else [cell(a, b, k), cell(b, a, k)])]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def profile(df: DataFrame, order: str = "row_idx") -> dict[str, dict]:
    """Everything about each column, as a nested mapping: a profile's size is that of the table's head, not its rows."""
    names = [c for c in df.columns if c != order]
    of = kind_map(df, names, order)
    out = {r.name: {"type": of[r.name], "count": r.n, "missing": r.missing, "missing_pct": r.missing_pct, "unique": r.unique} for r in missing(df, names).collect()}
    numeric = [n for n in names if of[n] == "continuous"]
    for r in summary(df, numeric).collect() if numeric else []:
        out[r.name] |= {k: r[k] for k in ("min", "max", "mean", "median", "std", "q25", "q75", "skewness")}
    for r in histogram(df, numeric).orderBy("name", "bin").collect() if numeric else []:
        out[r.name].setdefault("histogram", []).append({"bin": r.edge, "count": r.n})
    if other := [n for n in names if of[n] != "continuous"]:
        for r in value_counts(df, other, order=order).orderBy("name", "place").collect():
            out[r.name].setdefault("value_counts", {})[r.value] = r.n
    return {n: out[n] for n in names if n in out}


def distribution(profile_: dict[str, dict], column: str) -> dict:
    if column not in profile_:
        raise KeyError(f"no such column: {column}")
    return profile_[column]


def stats(df: DataFrame, order: str = "row_idx") -> dict:
    """Rows, columns, kinds and the overall share of missing cells."""
    names = [c for c in df.columns if c != order]
    return {"rows": df.count(), "columns": len(names), "column_types": kind_map(df, names, order), "missing_pct": overall_missing(df, names).first()[0]}
