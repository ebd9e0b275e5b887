"""Session helpers: tables, the shared folder, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors, once per application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="harbormill-"))
    atexit.register(shutil.rmtree, folder, True)
    archive = folder / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from ``spark.checkpoint.dir``.  Only where that is unset and all runs on one machine, as in
    tests, a temporary folder takes its place; on a cluster this is an error, since executors would write to their own disks.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="harbormill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def over_keys(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """``df.mapInPandas(run)`` with the key as text in between, since a null among whole numbers would turn
    them into floats in pandas.  ``schema`` has the columns behind the key."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    out = df.withColumn(key, df[key].cast("string")).mapInPandas(run, f"{key} string, {schema}")
    return out if kind == "string" else out.withColumn(key, out[key].cast(kind))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/harbormill-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: lineage is cut, the rows
    survive the loss of any executor, and later joins know the real size.

    ``lean`` removes the shuffle files of this step as soon as it is written instead of whenever the driver collects its garbage."""
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP)
    try:
        spark.conf.set(_CLEANUP, "true" if lean else before)
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table of ``written`` that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; its folder is the cluster's to clean
        pass
