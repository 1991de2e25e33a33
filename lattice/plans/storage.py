"""Queries that go through sources, sinks, the catalog and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export, tuning
from ..session import new_path
from ..sources import tables
from ..sources.catalog import Catalog, validate
from ..streaming import scoring
from .base import Book, table
from .learning import _BAYES, NAMES, _features

BOOK = Book()

_PART = "SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS row_idx, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part"


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").orderBy("p_partkey").coalesce(1)


@BOOK.add("scan_csv", _PART)
def scan_csv(spark, sf_dir):
    path = new_path(spark)
    _part(spark, sf_dir).write.option("header", True).csv(path)
    return tables.read_csv(spark, path)


@BOOK.add("scan_json", _PART)
def scan_json(spark, sf_dir):
    path = new_path(spark)
    _part(spark, sf_dir).write.json(path)
    return tables.read_json(spark, path)


@BOOK.add("scan_labeled_csv", "SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS row_idx, p_name, p_brand, CAST(p_size AS VARCHAR) AS label FROM part")
def scan_labeled_csv(spark, sf_dir):
    path = new_path(spark)
    _part(spark, sf_dir).write.option("header", True).csv(path)
    return tables.labeled_csv(spark, path).drop("p_partkey")


@BOOK.add("literal_rows", "SELECT * FROM (VALUES (0, '1.5', 'a'), (1, '2', NULL)) t(row_idx, x, y)")
def literal_rows(spark, sf_dir):
    return tables.from_rows(spark, [{"x": 1.5, "y": "a"}, {"x": 2, "y": None}])


@BOOK.add("json_rows", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_rows(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return r.select("r_regionkey", tables.row_json(r))


@BOOK.add("append_log", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def append_log(spark, sf_dir):
    path, r = new_path(spark), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    tables.append(r, path)
    tables.append(r, path)
    return spark.read.parquet(path)


@BOOK.add("catalog", "SELECT * FROM (VALUES (3::BIGINT, 'c', 'created'), (1, 'a', 'trained')) t(id, name, status)")
def catalog(spark, sf_dir):
    c = Catalog(spark, new_path(spark))
    for name in "abc":
        c.insert("projects", name=name, task_type="regression", status="created")
    c.update("projects", 1, status="trained", best_model_id=7)
    c.delete("projects", 2)
    return c.listing("projects").select("id", "name", "status")


@BOOK.add("catalog_filter", "SELECT 2::BIGINT AS id, 'tuned' AS status")
def catalog_filter(spark, sf_dir):
    c = Catalog(spark, new_path(spark))
    for status in ("completed", "tuned", "failed"):
        c.insert("model_runs", project_id=1, algorithm="knn", status=status)
    return c.listing("model_runs", F.col("project_id") == 1, F.col("status") == "tuned").select("id", "status")


@BOOK.add("model_save_load", _BAYES + " SELECT row_idx, prediction, prediction AS again FROM b")
def model_save_load(spark, sf_dir):
    df, path = _features(spark, sf_dir), new_path(spark)
    pipeline = tuning.fit(df, NAMES, "naive_bayes")
    tuning.save(pipeline, path)
    again = tuning.load(spark, path).transform(df).select("row_idx", F.col("prediction").alias("again"))
    return pipeline.transform(df).join(again, "row_idx").select("row_idx", "prediction", "again")


@BOOK.add("report", "SELECT 2 AS total, 'b' AS best")
def report(spark, sf_dir):
    import json

    runs = [{"algorithm": "a", "metrics": {"rmse": 2.0}}, {"algorithm": "b", "metrics": {"rmse": 1.0}}]
    r = json.loads(export.report({"name": "p"}, {"name": "d", "rows": 1}, runs, "regression"))
    return spark.createDataFrame([(r["summary"]["total"], r["summary"]["best"]["algorithm"])], "total int, best string")


@BOOK.add("client_code")
def client_code(spark, sf_dir):
    return spark.createDataFrame([(x, export.client_code(x, "/models/1", ["a", "b"])) for x in ("python", "curl", "php")], "language string, code string")


@BOOK.add("stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Events through a stream of files; complete mode, so no window is dropped."""
    events = table(spark, sf_dir, "events")
    path, out, checkpoint = new_path(spark), new_path(spark), new_path(spark)
    events.select("ts", "event_type", "value").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(path)
    windows = scoring.windowed_summary(stream, "ts", "value", late="36500 days", by=("event_type",))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(out)

    windows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("start", "event_type", "n", F.round("mean", 6).alias("mean"), "min", "max")


@BOOK.add("stream_scoring", _BAYES + " SELECT * FROM b")
def stream_scoring(spark, sf_dir):
    df = _features(spark, sf_dir)
    pipeline = tuning.fit(df, NAMES, "naive_bayes")
    path, out, checkpoint = new_path(spark), new_path(spark), new_path(spark)
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    scoring.score_stream(stream, pipeline, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("row_idx", "prediction")


@BOOK.add("validation", "SELECT * FROM (VALUES ('dataset_id', 'dataset_id is not an integer'), ('name', 'name is required'), ('task_type', 'task_type is none of classification,regression,clustering')) t(field, error)")
def validation(spark, sf_dir):
    rules = {"name": "required|max_length[255]", "dataset_id": "required|integer", "task_type": "required|in_list[classification,regression,clustering]", "description": "max_length[1000]"}
    return spark.createDataFrame(list(validate({"name": "", "dataset_id": "x", "task_type": "ranking"}, rules).items()), "field string, error string")


@BOOK.add("dataset_delete", "SELECT 2::BIGINT AS id, 'kept' AS name")
def dataset_delete(spark, sf_dir):
    root = new_path(spark)
    c = Catalog(spark, root)
    table(spark, sf_dir, "region").write.parquet(f"{root}/files/one")
    c.insert("datasets", name="gone", file_path=f"{root}/files/one")
    c.insert("datasets", name="kept")
    c.delete_dataset(1)
    return c.listing("datasets").select("id", "name")


@BOOK.add("prediction_log", "SELECT 1::BIGINT AS id, 'a' AS prediction UNION ALL SELECT 2, 'b'")
def prediction_log(spark, sf_dir):
    c = Catalog(spark, new_path(spark))
    for p in "ab":
        c.log_prediction(project_id=1, model_run_id=1, input_data="{}", prediction=p)
    return c.table("predictions").select("id", "prediction")


@BOOK.add("single_predict", _BAYES + " SELECT 1::BIGINT AS id, prediction FROM b WHERE row_idx = (SELECT min(vec_id) FROM embeddings)")
def single_predict(spark, sf_dir):
    """One row, asked for by its values, as the log has it."""
    df, c = _features(spark, sf_dir), Catalog(spark, new_path(spark))
    row = df.orderBy("row_idx").first().asDict()
    tuning.predict_one(spark, tuning.fit(df, NAMES, "naive_bayes"), {k: row[k] for k in NAMES}, c, 1, 1)
    return c.table("predictions").select("id", "prediction")


@BOOK.add("run_history", "SELECT * FROM (VALUES ('run', 1::BIGINT, 'naive_bayes', 'completed'), ('run', 2, 'knn', 'failed'), ('prediction', 1, 'a', NULL)) t(kind, id, what, status)")
def run_history(spark, sf_dir):
    """Runs that training records (the second has a parameter out of range), and a prediction."""
    c = Catalog(spark, new_path(spark))
    project = c.insert("projects", name="p", task_type="classification", status="created")
    tuning.train_all(_features(spark, sf_dir), NAMES, [{"key": "naive_bayes"}, {"key": "knn", "params": {"k": 0}}], folds=2, catalog=c, project=project)
    c.log_prediction(project_id=project, prediction="a")
    return c.history(project)


@BOOK.add("batch_predict", _BAYES + " SELECT row_idx AS row, prediction FROM b")
def batch_predict(spark, sf_dir):
    df = _features(spark, sf_dir)
    return tuning.predict_rows(tuning.fit(df, NAMES, "naive_bayes"), df.select(*reversed(NAMES), "row_idx"))
