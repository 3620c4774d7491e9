"""Lineage cuts that survive lost executors, and shared folders for what is written between jobs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/tidewire-checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a session whose tasks all run in this process uses a local one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL


def shared_folder(spark: SparkSession, name: str) -> str:
    """A name of a new folder there."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder, and of unknown size to the planner.

    A checkpoint carries on what its plan was estimated at, a product over joins: each round of joins doubles that number's digits, until the driver
    has neither time nor memory to multiply it.
    """
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    done = frame.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().analyzed().rdd(), done.schema(), False), spark)
