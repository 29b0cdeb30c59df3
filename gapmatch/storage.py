"""The shared work folder: written tables cut the lineage, so a lost executor re-reads files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


CODEC = "zstd"  #: of written tables: texts, tokens and vectors take some two thirds of what they take with the default


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a single machine without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="gapmatch-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings, written with ``_`` for ``.``, for the jobs that run inside."""
    names = {name.replace("_", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def save(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> DataFrame:
    """Write a table as it is kept here, partitioned ``by`` columns, and read it back. The files of the shuffles that it took
    go with the job, not when the driver next collects its garbage."""
    with settings(df.sparkSession, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        writer = df.write.mode(mode).option("compression", CODEC)
        (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, spread_by: tuple = ()) -> DataFrame:
    """Write a table to the shared folder and read it back.

    ``spread_by`` hashes the rows over the configured shuffle partitions first: for small tables whose
    rows cost much work later, which would otherwise be packed into one file and one task.
    """
    spark = df.sparkSession
    if spread_by:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *spread_by)
    return save(df, new_path(spark, name))


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    files, place = _folder(spark, path)
    files.delete(place, True)


def held_bytes(spark: SparkSession, path: str) -> int:
    """What a folder of the shared store takes; none if it is not there."""
    files, place = _folder(spark, path)
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder of the shared store where another was."""
    files, place = _folder(spark, target)
    files.delete(place, True)
    files.mkdirs(place.getParent())
    if not files.rename(_folder(spark, source)[1], place):
        raise OSError(f"{source} could not be put at {target}")


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(files, bytes, newest change) of a stored table: another value means that the table has changed."""
    files, place = _folder(spark, path)
    listed, found = files.listFiles(place, True), []
    while listed.hasNext():
        status = listed.next()
        found.append((status.getLen(), status.getModificationTime()))
    return len(found), sum(size for size, _ in found), max((when for _, when in found), default=0)
