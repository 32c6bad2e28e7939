"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "kinloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the results depend on (UTC, AQE with skew handling).

    Parallelism is left to the cluster's own configuration unless given in ``conf``.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for key, value in ADAPTIVE.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# Runtime settings every query relies on. A join that feeds an aggregate on the same keys
# is split on a hot key only when AQE may add the shuffle this costs.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode; such a stage runs much
    # faster as split projections than as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Shuffles start in many small partitions, which AQE joins to tasks of a fixed size: a task
    # then needs no more memory when the tables grow.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Switch on adaptive execution with skew splitting in an existing session."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` decides. Only a local session without it (a test) gets a
    temporary folder; a cluster without it is an error, since a folder on one machine
    is lost together with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="kinloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


# What Parquet keeps as it is; anything else is settled as a checkpoint.
PLAIN = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DecimalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, T.StructType):
        names = [f.name.lower() for f in kind.fields]
        return 0 < len(names) == len(set(names)) and all(_plain(f.dataType) for f in kind.fields)
    return type(kind) in PLAIN


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: nobody reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written rows.

    Used where later steps must see one fixed materialisation (row numbers given by a
    sampled range partitioning) or where an iteration would grow the plan without end.
    The rows are kept as compressed Parquet, a fraction of a checkpoint's serialised rows, of
    which later steps read the columns they need; the shuffles that made them are removed.
    """
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    if not _plain(df.schema):
        return df.checkpoint(eager=True)
    path = f"{folder}/kinloom/settled-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is configured for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
