"""Spark event logs (``spark.eventLog.enabled``) as a timing source: stage
and job durations read back with the JSON source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STAGE_INFO = T.StructType([
    T.StructField("Stage ID", T.LongType()), T.StructField("Stage Attempt ID", T.LongType()),
    T.StructField("Stage Name", T.StringType()), T.StructField("Number of Tasks", T.LongType()),
    T.StructField("Submission Time", T.LongType()), T.StructField("Completion Time", T.LongType()),
])
EVENT_SCHEMA = T.StructType([
    T.StructField("Event", T.StringType()),
    T.StructField("Stage Info", _STAGE_INFO),
    T.StructField("Job ID", T.LongType()),
    T.StructField("Submission Time", T.LongType()),
    T.StructField("Completion Time", T.LongType()),
])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path)


def stage_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row per completed stage attempt: id, name, tasks, milliseconds."""
    ev = read_events(spark, path).filter(F.col("Event") == "SparkListenerStageCompleted")
    si = F.col("`Stage Info`")
    return ev.select(si["Stage ID"].alias("stage_id"), si["Stage Attempt ID"].alias("attempt"),
                     F.split(si["Stage Name"], " ")[0].alias("operation"),
                     si["Number of Tasks"].alias("tasks"),
                     (si["Completion Time"] - si["Submission Time"]).alias("duration_ms"))


def job_summary(spark: SparkSession, path: str) -> DataFrame:
    """Job wall-clock from the start/end events (joined on job id)."""
    ev = read_events(spark, path)
    start = ev.filter(F.col("Event") == "SparkListenerJobStart").select(
        "Job ID", F.col("Submission Time").alias("t0"))
    end = ev.filter(F.col("Event") == "SparkListenerJobEnd").select(
        "Job ID", F.col("Completion Time").alias("t1"))
    return start.join(end, "Job ID").select(F.col("Job ID").alias("job_id"),
                                            (F.col("t1") - F.col("t0")).alias("duration_ms"))


def current_log_path(spark: SparkSession) -> str | None:
    """The live application's event log file, if logging is on."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.eventLog.enabled", "false").lower() != "true":
        return None
    base = conf.get("spark.eventLog.dir").rstrip("/")
    return f"{base}/{spark.sparkContext.applicationId}*"
