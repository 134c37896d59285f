"""Session construction and the shared staging location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Model calls must not be duplicated by speculative copies of a task.
    "spark.speculation": "false",
}

BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of one Arrow batch sent to a Python worker, where the session sets no bound.
BATCH_BYTES = 8 << 20


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "casegrid", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes unless the session was given a bound, so
    that long texts do not meet by the thousand in one Python worker.  Spark's
    own default (64 MB, or none in older versions) is not a choice of the
    session's."""
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, stable across driver restarts.

    The base is the session's ``spark.checkpoint.dir`` (on a cluster this
    must name storage all executors share).  A checkpoint directory set only
    through ``setCheckpointDir`` carries a per-context id; its parent is used
    so a restarted driver finds the same folder.  Only a local-mode session
    with neither gets a fresh scratch folder of its own (tests, local runs)."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/").rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="casegrid-stage-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{staging_root(spark).rstrip('/')}/casegrid/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what it cost to make
    is paid once, and a lost executor costs no more than a rereading."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
