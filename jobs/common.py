"""What the jobs share: config files, paths of a stream, logs."""

from __future__ import annotations

import json
import logging
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent


def config(name: str, path: str | None = None, spark: SparkSession | None = None) -> dict:
    """The settings of a job's own file, with those of another file (of any file system that Spark reads) in their place."""
    out = json.loads((HERE / f"{name}.json").read_text())
    if path:
        row = spark.read.text(path, wholetext=True).first()
        more = json.loads(row[0]) if row else {}
        if unknown := set(more) - set(out):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= more
    return out


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def as_pattern(path: str) -> str:
    """A path as a pattern that only it fits. A stream of files takes a plain path for a folder, and a pattern for files and folders alike."""
    head, slash, last = path.rstrip("/").rpartition("/")
    return path if re.search(r"[*?\[{]", last) else f"{head}{slash}{last[:-1]}[{last[-1]}]"


def read_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A partitioned table as it was written: Spark would take a partition's name for a number if it looks like one."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
