"""Sinks by dataset and split, and the ingest of new documents as a stream.

A sink's folders are replaced one by one: a second run replaces the folders for which it has rows and leaves all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import dataset_of, plain_path, video_of
from .documents import bad_document, fields_of, skipped

#: Rows of a file, about; a folder has as many files as its rows ask for, and each is written by one task.
ROWS_A_FILE = 1_000_000


def dealt(rows: DataFrame, keys: list[str], spread: list[str], rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """rows repartitioned for folders by keys: a folder's rows go to as many tasks as it needs files, by a hash of `spread`.

    The rows are counted by folder first (a row for each folder, of which there are few), so a hot dataset is spread over many
    tasks and a small one isn't cut up. spread: columns that tell rows apart, so that a task that is run again gets the same rows."""
    sizes = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.ceil(F.count("*") / rows_a_file).alias("_files"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    placed = rows.join(F.broadcast(sizes), same).withColumn("_file", F.pmod(F.xxhash64(*spread), "_files"))
    return placed.repartition(*keys, "_file").select(*rows.columns)


def save_by(rows: DataFrame, path: str, keys: list[str], spread: list[str], form: str = "parquet", rows_a_file: int = ROWS_A_FILE) -> None:
    """Writes rows in folders by keys; only the folders for which there are rows are replaced."""
    out = dealt(rows, keys, spread, rows_a_file)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(form).save(path)


def clip_path(name: Column, split: Column) -> Column:
    """Where a clip's questions are looked for: those of the training split lie at the root, others in a folder of their own."""
    return F.when(split == "train", F.concat(name, F.lit(".json"))).otherwise(F.concat(split, F.lit("/"), name, F.lit(".json")))


def arriving(spark: SparkSession, path: str, schema: str, ending: str = "*.json", files: int | None = None, lines: bool = False) -> DataFrame:
    """Documents as they arrive in a folder, one row each: path, arrived, the fields of schema, _corrupt_record. Derived
    documents that lie beside them are skipped. files: how many a batch takes at most. lines: a document is a line, not a file."""
    stream = spark.readStream.schema(f"{schema}, _corrupt_record string").option("multiLine", not lines).option("pathGlobFilter", ending).option("recursiveFileLookup", True)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    rows = stream.json(path)
    kept = rows.withColumns({"path": plain_path(F.col("_metadata.file_path")), "arrived": F.col("_metadata.file_modification_time")})
    return kept.where(~skipped(F.col("path")))


def ingest(spark: SparkSession, path: str, schema: str, table: str, datasets: list[str], ending: str = "*.json", files: int | None = None, lines: bool = False) -> StreamingQuery:
    """Takes in the documents that are new in a folder, and ends when there are no more.

    table/documents has the good ones (video_id, path, fields) in folders by dataset and batch; table/bad has path and dataset
    of those that don't parse or have none of the fields. table/checkpoint remembers which files were read: a run that was
    stopped goes on with its unfinished batch, whose folders it replaces, so that nothing is lost or taken twice. A video that
    an earlier batch has is left out, whatever its file is called now; within a batch the first path counts. The video's name is
    the document's video_id, if schema has that, else its file's."""
    own = "video_id" in fields_of(schema)

    def take(rows: DataFrame, batch: int) -> None:
        rows = rows.withColumns({"dataset": dataset_of(F.col("path"), datasets), "video_id": F.col("video_id") if own else video_of(F.col("path")), "batch": F.lit(batch)})
        rows = rows.persist()  # read by both writes; files are whole rows, so this is bounded by the batch
        wrong = bad_document(rows, fields_of(schema))
        good = rows.where(~wrong).drop("_corrupt_record")
        good = good.dropDuplicates(["dataset", "video_id", "path"])
        first = good.groupBy("dataset", "video_id").agg(F.min("path").alias("path"))
        good = good.join(first, ["dataset", "video_id", "path"], "left_semi")
        if known := taken(spark, table):
            good = good.join(known.where(F.col("batch") != batch).select("dataset", "video_id").distinct(), ["dataset", "video_id"], "left_anti")
        replace(good, f"{table}/documents")
        replace(rows.where(wrong).select("path", "arrived", "dataset", "batch"), f"{table}/bad")
        rows.unpersist()

    def replace(rows: DataFrame, to: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "batch").parquet(to)

    stream = arriving(spark, path, schema, ending, files, lines)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{table}/checkpoint").trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def taken(spark: SparkSession, table: str, kind: str = "documents") -> DataFrame | None:
    """What ingest() has taken in so far, or its bad documents; None before the first."""
    path = f"{table}/{kind}"
    if not exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except Exception as x:  # a folder without rows has no schema
        if "UNABLE_TO_INFER_SCHEMA" in str(x):
            return None
        raise


def ingest_outcome(spark: SparkSession, table: str) -> DataFrame:
    """documents and bad by dataset."""
    parts = [d.select("dataset", F.lit(kind).alias("kind")) for kind in ("documents", "bad") if (d := taken(spark, table, kind)) is not None]
    if not parts:
        return spark.createDataFrame([], "dataset string, documents long, bad long")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("dataset").agg(F.count_if(F.col("kind") == "documents").alias("documents"), F.count_if(F.col("kind") == "bad").alias("bad"))
