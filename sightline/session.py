"""Session settings, and shipping the package to executors that don't have it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What the jobs expect of a session; each can be set otherwise.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{here.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent).as_posix())
    spark.sparkContext.addPyFile(path)


def prepare(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    ship(spark)
    return spark


_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset and Spark runs in one process (tests) a local one: on a
    cluster, executors wouldn't see it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark)}/sightline/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all that queries have written to the shared folder, once their results aren't read any more."""
    for t in spark.catalog.listTables():
        if t.name.startswith("sightline_"):
            spark.sql(f"DROP TABLE {t.name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/sightline")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read back, where several queries read it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_clustered(df: DataFrame, name: str, key: str) -> DataFrame:
    """save() in buckets by key, as many as a shuffle has partitions: what groups, joins or windows its rows by the key (and other
    columns) needs no shuffle any more, however often it is read."""
    spark = df.sparkSession
    table, path = f"sightline_{name}_{uuid.uuid4().hex}", new_path(spark, name)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)
