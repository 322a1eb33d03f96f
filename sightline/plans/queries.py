"""The registered queries of the library: name -> function of (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, evaluation, gaze, jobs, questions, texts, timeline, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = gaze.QUERIES | timeline.QUERIES | documents.QUERIES | evaluation.QUERIES | questions.QUERIES | texts.QUERIES | tracks.QUERIES | jobs.QUERIES
ORACLE: dict[str, str] = gaze.ORACLE | timeline.ORACLE | documents.ORACLE | evaluation.ORACLE | questions.ORACLE | texts.ORACLE | tracks.ORACLE | jobs.ORACLE
