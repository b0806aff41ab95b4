"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
HUGE_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"

_local_scratch: dict[str, str] = {}


def local_session(cores: int | str = 8, **conf) -> SparkSession:
    """A single-machine session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("maskloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Keep generated code within what the JVM compiles.

    A policy over several columns becomes one generated method. Beyond 8,000 bytes of bytecode
    HotSpot only interprets it, at half the speed or less; with this limit Spark generates
    many small methods instead. A limit that was already lowered is left alone.
    """
    if int(spark.conf.get(HUGE_METHOD_LIMIT, "65535")) > 8000:
        spark.conf.set(HUGE_METHOD_LIMIT, "8000")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A temporary folder of this machine stands in only for a local master.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="maskloom-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def column(name: str) -> Column:
    """Reference a column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
