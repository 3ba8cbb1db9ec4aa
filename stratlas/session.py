"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "/tmp/checkpoints/stratlas"


def session(name: str = "stratlas", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` overrides."""
    builder = SparkSession.builder.appName(name)
    for key, value in ({"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the context, which all executors share; one of this machine only in local mode, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not jsc.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or LOCAL_SHARED)
    return jsc.getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Written to the shared folder and cut from its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int) -> bool:
    """At most ``rows`` rows, without counting more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of at most ``size`` bytes from here on, a smaller setting of the session is kept: rows may hold whole blocks."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(key, str(size))


class Scratch:
    """Tables in the shared folder for as long as a loop needs them.

    A table that is read again knows nothing of how it was made or dealt out, so
    plans of many rounds stay as small as those of one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove all of them; what is still to be read has to be materialised before."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
