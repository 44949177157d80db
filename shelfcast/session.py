"""Session helpers: configuration for scale, shared scratch space, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(
    app: str = "shelfcast",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session configured for adaptive execution.

    On a cluster the master and resources come from spark-submit; ``master`` is
    only for local runs and tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and lineage cuts.

    Read from ``spark.checkpoint.dir`` (the cluster's shared folder). Where it
    is unset, a local master (tests) gets a fresh local folder; on a cluster
    that would not be shared, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="shelfcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_output_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared scratch folder."""
    return f"{scratch_dir(spark)}/out/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` once as a parquet table under the shared
    checkpoint folder and reading it back (one computation; later plans start
    from a pruned, filter-pushed scan and survive executor loss)."""
    path = new_output_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # known: no job to infer it


def written_lookup(df: DataFrame, name: str) -> DataFrame:
    """A side that several joins read, written once: the planner knows its size in
    bytes from the files and broadcasts it or not by its own limit."""
    return materialize(df, f"lookup-{name}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of ``path``."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a table written under the shared folder that nothing reads any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
