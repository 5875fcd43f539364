"""Paths of files that Python code opens by itself, and room for a query's own files."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_own: dict[str, str] = {}


def filesystem(path: str):
    """pyarrow's file system for a path, and the path in it. Hadoop's names of one store are several; pyarrow knows it by one."""
    from pyarrow import fs

    if not re.match(r"\w+:", path):
        return fs.FileSystem.from_uri(f"file://{path}")
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/(?=[^/])", "file:///", path)))


def in_order(rows: DataFrame, by: Column | str, *keys: str) -> DataFrame:
    """rows in ranges of ``by``, each sorted by ``keys`` (or by ``by``), for writing part by part.

    An orderBy has its ranges put together by AQE up to a size in compressed bytes. Reads compress tenfold and more, so a
    task would sort ten times as much, in fewer tasks than there are cores; a number that is named stays as it is."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, by).sortWithinPartitions(*(keys or (by,)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir. Only a local session without one gets its own."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="readloom-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        conf = f"file://{_own['dir']}"
    return f"{conf.rstrip('/')}/readloom/{name}-{uuid.uuid4().hex}"
