"""Where jobs put tables that they need more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder for a local master that has none."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_own[0]}"


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, what follows is computed once, and lost executors lose
    nothing. Spark removes the shuffles behind it once it is written. ``drop_staged`` removes what is no longer needed."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Remove what ``staged`` wrote of these tables, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores, dealt out to all cores.

    A file of one row group is one task's work, however long what follows takes. Only small
    tables have so few splits; what a cluster reads has more and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
