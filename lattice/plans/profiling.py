"""Queries that profile record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, profile
from ..sources import tables
from .base import Book, table

BOOK = Book()
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long(columns: list[str], source: str, cast: str = "DOUBLE") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS {cast}) AS v FROM {source}" for c in columns)


def _summary_sql(long: str) -> str:
    return f"""WITH l AS ({long}), m AS (SELECT name, count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, median(v) AS median, stddev_pop(v) AS std FROM l GROUP BY name),
r AS (SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY v) - 1 AS k FROM l),
q AS (SELECT r.name, max(v) FILTER (WHERE k = CAST(floor(n * 0.25) AS BIGINT)) AS q25, max(v) FILTER (WHERE k = CAST(floor(n * 0.75) AS BIGINT)) AS q75 FROM r JOIN m USING (name) GROUP BY r.name),
s AS (SELECT l.name, avg(power((v - mean) / nullif(std, 0), 3)) AS g FROM l JOIN m USING (name) GROUP BY l.name)
SELECT name, n, lo AS min, hi AS max, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, q25, q75, CASE WHEN n < 3 OR std = 0 THEN 0.0 ELSE coalesce(round(g, 4) + 0.0, 0.0) END AS skewness FROM m JOIN q USING (name) JOIN s USING (name)"""


@BOOK.add("profile_numeric", _summary_sql(_long(NUMERIC, "lineitem")))
def profile_numeric(spark, sf_dir):
    out = profile.summary(table(spark, sf_dir, "lineitem"), NUMERIC)
    return out.withColumn("skewness", F.col("skewness") + F.lit(0.0))


@BOOK.add("profile_events", _summary_sql(_long(["value"], "events")))
def profile_events(spark, sf_dir):
    return profile.summary(table(spark, sf_dir, "events"), ["value"]).withColumn("skewness", F.col("skewness") + F.lit(0.0))


_NUM = r"'^[ \t\n\r\x0B\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\x0B\f]*$'"
_ORDERS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_clerk"]


def _orders_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.round("o_totalprice", 0).cast("long").cast("string")).alias("o_totalprice"), "o_orderpriority")
    return o.withColumn("o_clerk", F.concat(F.lit("clerk "), F.col("row_idx").cast("string")))


_TEXT = "(SELECT o_orderkey AS row_idx, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(CAST(round(o_totalprice, 0) AS BIGINT) AS VARCHAR) END AS o_totalprice, o_orderpriority, 'clerk ' || o_orderkey AS o_clerk FROM orders)"


def _text_long(names: list[str], source: str = _TEXT) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS x, row_idx AS o FROM {source}" for c in names)


@BOOK.add("type_inference", f"""WITH t AS (SELECT * FROM {_TEXT} ORDER BY row_idx LIMIT 100), l AS ({_text_long(_ORDERS, 't')})
SELECT name, CASE WHEN count(*) FILTER (WHERE x <> '') = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE x <> '' AND regexp_matches(x, {_NUM})) >= 0.95 * count(*) FILTER (WHERE x <> '') THEN 'continuous' WHEN count(DISTINCT coalesce(x, '')) <= 20 THEN 'categorical' ELSE 'string' END AS kind FROM l GROUP BY name""")
def type_inference(spark, sf_dir):
    return profile.kinds(_orders_text(spark, sf_dir), _ORDERS)


@BOOK.add("profile_missing", f"WITH l AS ({_text_long(_ORDERS)}) SELECT name, count(*) AS n, count(*) FILTER (WHERE x IS NULL OR x = '') AS missing, round(100.0::DOUBLE * count(*) FILTER (WHERE x IS NULL OR x = '') / count(*), 2) AS missing_pct, count(DISTINCT coalesce(x, '')) AS unique FROM l GROUP BY name")
def profile_missing(spark, sf_dir):
    return profile.missing(_orders_text(spark, sf_dir), _ORDERS)


@BOOK.add("overall_missing", f"WITH l AS ({_text_long(_ORDERS)}) SELECT round(avg(p), 2) AS missing_pct FROM (SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE x IS NULL OR x = '') / count(*), 2) AS p FROM l GROUP BY name)")
def overall_missing(spark, sf_dir):
    return profile.overall_missing(_orders_text(spark, sf_dir), _ORDERS)


@BOOK.add("dataset_stats", f"SELECT count(*) AS rows, 5::BIGINT AS columns, (SELECT round(avg(p), 2) FROM (SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE x IS NULL OR x = '') / count(*), 2) AS p FROM ({_text_long(_ORDERS)}) GROUP BY name)) AS missing_pct FROM orders")
def dataset_stats(spark, sf_dir):
    s = profile.stats(_orders_text(spark, sf_dir))
    return spark.createDataFrame([(s["rows"], s["columns"], s["missing_pct"])], "rows long, columns long, missing_pct double")


@BOOK.add("numeric_filter", f"SELECT row_idx, CAST(o_totalprice AS DOUBLE) AS v FROM {_TEXT} WHERE regexp_matches(o_totalprice, {_NUM})")
def numeric_filter(spark, sf_dir):
    from ..functions.text import float_value, is_numeric

    return _orders_text(spark, sf_dir).where(is_numeric(F.col("o_totalprice"))).select("row_idx", float_value(F.col("o_totalprice")).alias("v"))


@BOOK.add("non_missing_filter", f"SELECT row_idx FROM {_TEXT} WHERE o_totalprice IS NOT NULL AND o_totalprice <> ''")
def non_missing_filter(spark, sf_dir):
    return dataset.non_missing(_orders_text(spark, sf_dir), "o_totalprice").select("row_idx")


def _histogram_sql(long: str, bins: int = 10) -> str:
    return f"""WITH l AS ({long}), e AS (SELECT name, min(v) AS lo, max(v) AS hi FROM l GROUP BY name),
c AS (SELECT name, CASE WHEN hi = lo THEN 0 ELSE least({bins - 1}, CAST(floor((v - lo) / ((hi - lo) / {bins}.0::DOUBLE)) AS INTEGER)) END AS bin, count(*) AS n FROM l JOIN e USING (name) GROUP BY ALL),
f AS (SELECT name, lo, hi, unnest(range(CASE WHEN hi = lo THEN 1 ELSE {bins} END)) AS bin FROM e)
SELECT name, CAST(bin AS INTEGER) AS bin, round(lo + bin * ((hi - lo) / {bins}.0::DOUBLE), 3) AS edge, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (name, bin)"""


@BOOK.add("histogram_lineitem", _histogram_sql(_long(NUMERIC, "lineitem")))
def histogram_lineitem(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "lineitem"), NUMERIC)


@BOOK.add("histogram_customer", _histogram_sql(_long(["c_acctbal"], "customer"), 7))
def histogram_customer(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "customer"), ["c_acctbal"], 7)


def _counts_sql(long: str) -> str:
    return f"SELECT name, value, n, CAST(k AS INTEGER) AS place FROM (SELECT name, x AS value, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(o), x) AS k FROM ({long}) WHERE x IS NOT NULL AND x <> '' GROUP BY name, x) WHERE k <= 20"


@BOOK.add("value_counts_orders", _counts_sql(_text_long(["o_orderstatus", "o_orderpriority", "o_totalprice"])))
def value_counts_orders(spark, sf_dir):
    return profile.value_counts(_orders_text(spark, sf_dir), ["o_orderstatus", "o_orderpriority", "o_totalprice"])


@BOOK.add("value_counts_part", _counts_sql("SELECT 'p_brand' AS name, p_brand AS x, p_partkey AS o FROM part UNION ALL SELECT 'p_type', p_type, p_partkey FROM part"))
def value_counts_part(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type"], order="p_partkey")


def _correlation_sql(columns: dict[str, str], source: str) -> str:
    one = "SELECT '{a}' AS a, '{b}' AS b, CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 4), 0.0) + 0.0 END AS r FROM {s}"
    return " UNION ALL ".join(one.format(a=a, b=b, x=x, y=y, s=source) for a, x in columns.items() for b, y in columns.items())


@BOOK.add("correlation_lineitem", _correlation_sql({c: c for c in NUMERIC}, "lineitem"))
def correlation_lineitem(spark, sf_dir):
    return profile.correlation(table(spark, sf_dir, "lineitem"), NUMERIC).withColumn("r", F.col("r") + F.lit(0.0))


@BOOK.add("correlation_blank", _correlation_sql({"row_idx": "row_idx", "o_totalprice": "coalesce(try_cast(nullif(o_totalprice, '') AS DOUBLE), 0)"}, _TEXT))
def correlation_blank(spark, sf_dir):
    return profile.correlation(_orders_text(spark, sf_dir), ["row_idx", "o_totalprice"]).withColumn("r", F.col("r") + F.lit(0.0))


@BOOK.add("correlation_pairwise", _correlation_sql({"row_idx": "row_idx", "o_totalprice": "CAST(o_totalprice AS DOUBLE)"}, f"(SELECT * FROM {_TEXT} WHERE o_totalprice <> '')").replace("'row_idx' AS a, 'row_idx' AS b", "'row_idx' AS a, 'row_idx' AS b"))
def correlation_pairwise(spark, sf_dir):
    return profile.correlation(_orders_text(spark, sf_dir), ["row_idx", "o_totalprice"], drop_blank=True).withColumn("r", F.col("r") + F.lit(0.0))


@BOOK.add("full_profile", f"SELECT name, kind FROM (VALUES ('o_orderkey', 'continuous'), ('o_orderstatus', 'categorical'), ('o_totalprice', 'continuous'), ('o_orderpriority', 'categorical'), ('o_clerk', 'string')) t(name, kind)")
def full_profile(spark, sf_dir):
    p = profile.profile(_orders_text(spark, sf_dir))
    return spark.createDataFrame([(n, x["type"]) for n, x in p.items()], "name string, kind string")


@BOOK.add("column_distribution", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def column_distribution(spark, sf_dir):
    p = profile.profile(_orders_text(spark, sf_dir).select("row_idx", "o_orderstatus"))
    return spark.createDataFrame(list(profile.distribution(p, "o_orderstatus")["value_counts"].items()), "value string, n long")


@BOOK.add("task_type", "SELECT 'l_tax' AS target, 'regression' AS task UNION ALL SELECT 'p_brand', 'classification'")
def task_type(spark, sf_dir):
    a = profile.task_type(profile.kind_map(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax"), order="l_orderkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.concat("p_type", F.lit("")).alias("p_type"), "p_brand")
    kinds = profile.kind_map(part, order="p_partkey")
    b = profile.task_type({**kinds, "p_brand": "categorical" if kinds["p_brand"] != "continuous" else "continuous"})
    return spark.createDataFrame([a, b], "target string, task string")


@BOOK.add("build_dataset", "SELECT doc_id AS row_idx, CAST(n_chars AS DOUBLE) AS n_chars, lang, CAST(quality AS VARCHAR) AS label FROM documents JOIN labels USING (doc_id)")
def build_dataset(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "row_idx")
    return dataset.build_dataset(joined, ["n_chars", "lang"], "quality", {"n_chars": "continuous", "lang": "categorical"})


_SPARSE = "(SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '' ELSE CAST(o_custkey AS VARCHAR) || 'x' END AS num, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE o_orderstatus END AS cat, o_orderpriority AS y FROM orders)"


def _sparse(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("row_idx"), F.when(k % 3 == 0, None).when(k % 3 == 1, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("x"))).alias("num"), F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise(F.col("o_orderstatus")).alias("cat"), F.col("o_orderpriority").alias("y"))


@BOOK.add("build_dataset_missing", f"SELECT row_idx, CASE WHEN num IS NULL OR num = '' THEN -1.0 ELSE CAST(rtrim(num, 'x') AS DOUBLE) END AS num, coalesce(nullif(cat, ''), '?') AS cat, y AS label FROM {_SPARSE}")
def build_dataset_missing(spark, sf_dir):
    made = dataset.build_dataset(_sparse(spark, sf_dir), ["num", "cat"], "y", {"num": "continuous", "cat": "categorical"})
    return made.withColumn("num", F.when(F.isnan("num"), -1.0).otherwise(F.col("num")))


@BOOK.add("build_unlabeled", f"SELECT row_idx, CASE WHEN num IS NULL OR num = '' THEN 0.0 ELSE CAST(rtrim(num, 'x') AS DOUBLE) END AS num, coalesce(cat, '?') AS cat FROM {_SPARSE}")
def build_unlabeled(spark, sf_dir):
    return dataset.build_unlabeled(_sparse(spark, sf_dir), ["num", "cat"], {"num": "continuous", "cat": "categorical"})


@BOOK.add("feature_projection", "SELECT p_partkey, p_size, p_retailprice FROM part")
def feature_projection(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(*dataset.feature_names(part, "p_brand", drop=("p_name", "p_type")))


@BOOK.add("sample_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50")
def sample_rows(spark, sf_dir):
    return tables.sample(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 50, "c_custkey")


@BOOK.add("transform_labels", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS label FROM lineitem")
def transform_labels(spark, sf_dir):
    from ..functions.text import float_value

    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("string"), F.lit(" pieces")).alias("label"))
    return dataset.transform_labels(l, float_value)
