"""Cutting lineage through the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for applications whose session names none.
_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a local session and the warehouse for others."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        local = spark.sparkContext.master.startswith("local[")
        _MADE[app] = "file://" + tempfile.mkdtemp(prefix="tagloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tagloom"
    return _MADE[app]


#: Spark's setting by which a query's shuffle files go when it has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing.

    The shuffle files of the write go with it, as what is read later is the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by materialize that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
