"""Session helpers shared by the library, the benchmark and the tests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings while a table is written: shuffle files go when the query that wrote them has ended, and Python gets few
#: rows at once, as texts may be long.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def local_session(cpus: int = 8, memory: str = "8g", app: str = "lexigrove", shared: str = "/tmp/lexigrove-shared") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use; ``shared`` serves one machine only."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Unset on a cluster, that is an error: a folder of one machine would lose tables with an executor. A local master
    has one machine only, so there the session's warehouse serves.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/lexigrove-shared"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold for the block only."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Shelf:
    """Tables that one operator writes to a folder of its own in the shared directory.

    A written table cuts lineage: what reads it needs none of the shuffles before it, whose files go at once. ``drop``
    deletes tables as soon as nothing reads them any more; those that a lazy result still reads stay.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.tables)}"
        with settings(self.spark, WHILE_WRITING):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append(table)
        self.paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self.spark, self.paths.pop(id(table)))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage, so that a lost executor costs no recomputation."""
    return Shelf(df.sparkSession, "cut").put(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
