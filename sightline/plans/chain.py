"""Chains of stages whose results are kept, so that a run goes on where an earlier one stopped.

Each stage has a table, in folders by run, and a manifest says which run made which video's rows. A video's rows count only
if the manifest names their run: what a run wrote before it died is never read, and is made again. A stage is run for the
videos that the stages before it have and its manifest doesn't (an anti-join), so new videos alone are worked on, and a stage
whose manifest is taken away is made again from the results before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, features
from ..operators.reports import TYPES
from ..sources.sinks import exists


@dataclass(frozen=True)
class Stage:
    """make: from the rows of the stages named (`input` is the chain's input), of the videos to be done, to rows with video_id."""

    name: str
    make: Callable[..., DataFrame]
    reads: tuple[str, ...] = ("input",)


class Chain:
    def __init__(self, spark: SparkSession, root: str, stages: list[Stage]):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), stages

    def manifest(self, stage: str) -> DataFrame:
        """video_id and run of the videos that a stage has done; they may have no rows."""
        path = f"{self.root}/{stage}/manifest"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], "video_id string, run string")
        return self.spark.read.schema("video_id string, run string").parquet(path)

    def rows(self, stage: str) -> DataFrame:
        """A stage's rows, of the runs that its manifest names."""
        return self.spark.read.parquet(f"{self.root}/{stage}/rows").join(self.manifest(stage), ["video_id", "run"], "left_semi").drop("run")

    def run(self, source: DataFrame) -> dict[str, int]:
        """Brings all stages up to date with the videos of the input; the number of videos that each had to do."""
        did, videos = {}, source.select("video_id").distinct()
        for stage in self.stages:
            todo = videos.join(self.manifest(stage.name), "video_id", "left_anti")
            run = uuid.uuid4().hex
            # which videos a run does is settled before it begins, and kept: the manifest is a copy of it
            plan = f"{self.root}/{stage.name}/plan/{run}"
            todo.withColumn("run", F.lit(run)).write.parquet(plan)
            todo = self.spark.read.schema("video_id string, run string").parquet(plan)
            did[stage.name] = todo.count()
            if did[stage.name] or not exists(self.spark, f"{self.root}/{stage.name}/rows"):
                inputs = [(source if r == "input" else self.rows(r)).join(todo.select("video_id"), "video_id", "left_semi") for r in stage.reads]
                stage.make(*inputs).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{self.root}/{stage.name}/rows")
                todo.write.mode("append").parquet(f"{self.root}/{stage.name}/manifest")
        return did


def confirmed(candidates: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Candidates with what an outside classifier says of them (video_id, event_id, confirmed), null where it doesn't.

    Candidates are few for each video, verdicts may be many: the hint keeps verdicts from being broadcast or sorted, whatever
    their size is taken for."""
    if verdicts is None:
        return candidates.withColumn("confirmed", F.lit(None).cast("boolean"))
    return candidates.hint("shuffle_hash").join(verdicts.select("video_id", "event_id", "confirmed"), ["video_id", "event_id"], "left")


def gaze_chain(spark: SparkSession, root: str, verdicts: DataFrame | None = None, least: float = 0.75, most: int = 15) -> Chain:
    """From gaze rows to events, candidates for checking and counts: features, frames, events, candidates, counts.

    counts: for each video, events, candidates, confirmed and rejected ones, and the events of each kind."""

    def counts(found: DataFrame, chosen: DataFrame) -> DataFrame:
        marked = found.join(chosen.select("video_id", "event_id", "rank", "confirmed"), ["video_id", "event_id"], "left")
        return marked.groupBy("video_id").agg(F.count("*").alias("events"), F.count("rank").alias("candidates"), F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("rejected"), *(F.count_if(F.col("event_type") == t).alias(t) for t in TYPES))

    return Chain(
        spark,
        root,
        [
            Stage("features", features.features),
            Stage("frames", features.frame_features, ("features",)),
            Stage("events", events.all_events, ("features", "frames")),
            Stage("candidates", lambda found: confirmed(events.candidates(found, least, most), verdicts), ("events",)),
            Stage("counts", counts, ("events", "candidates")),
        ],
    )
