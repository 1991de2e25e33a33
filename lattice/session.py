"""The session that queries and tools run in."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lattice", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ANSI mode stays on."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lattice-checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the session's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lattice/{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Applications whose workers have this package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Spark send this package to all workers, which need not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="lattice-package-")) / "lattice.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(made))
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow, with this package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
