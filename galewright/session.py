"""Session helpers shared by every operator: table access, local sessions, shared checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(name: str = "galewright", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for tests and local runs; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GALEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` where it is set, a temporary one only for local runs."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="galewright-")
        sc._jvm.org.apache.hadoop.fs.FileSystem.getLocal(sc._jsc.hadoopConfiguration()).deleteOnExit(sc._jvm.org.apache.hadoop.fs.Path(path))
    sc.setCheckpointDir(path)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, which is deleted when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files, so that lost executors cost nothing and later
    readers take the columns they need. The caller selects the columns that are needed at all."""
    path = shared_folder(df.sparkSession, "rows")
    plain = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*plain).write.mode("overwrite").parquet(path)
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, df.schema.fields)])
    return df.sparkSession.read.schema(schema).parquet(path).toDF(*df.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def as_double(name: str):
    """The column as a double with NaN turned to null."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def epoch_seconds(df: DataFrame, name: str):
    """Whole seconds since 1970 UTC of a timestamp column; one without zone holds UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_seconds(F.col(name).cast("timestamp"))
