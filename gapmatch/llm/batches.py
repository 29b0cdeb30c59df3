"""Arrow batches of bounded size, workers that give memory back, and names that clash with no column."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def bounded_batches(spark: SparkSession) -> None:
    """Ten thousand texts in a batch can be more than a worker holds: ask for smaller ones, unless the session says otherwise."""
    for name, (usual, wanted) in LIMITS.items():
        now = spark.conf.get(name, None)
        if now is None or str(now) == usual:
            spark.conf.set(name, wanted)


def trim() -> None:
    """Memory that is free inside this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release() -> None:
    """The same, after what only cycles hold has been let go: workers live on from stage to stage."""
    gc.collect()
    trim()


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of Arrow batches; memory that earlier stages or batches left is released."""
    def call(batches):
        release()
        for out in run(batches):
            yield out
            trim()
        release()

    return call


def tidied_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same function of a group; memory that it used is released."""
    def call(table):
        out = run(table)
        trim()
        return out

    return call


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many closing underscores as make it differ from all columns and each other."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
