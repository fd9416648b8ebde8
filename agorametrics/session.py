"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All of these can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One account or one viral post may hold a third of the rows: split its partition at
    # run time, also where the split costs the aggregation behind the join a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Data partitioned by account also counts as clustered by (account, slice), which would save a
    # shuffle and leave a hot account in one task: insist on all keys.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sinks that replace a slice rewrite only the partitions they touch.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# A task that aggregates or sorts short rows holds its share of them, so shares are bounded in bytes: stored rows
# are read in small splits, and shuffles start with many partitions, of which AQE makes as few as the size asks for.
SHORT_ROWS_CONF = {
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
}


def configure(spark: SparkSession, short_rows: bool = False) -> SparkSession:
    """Set the runtime options every operator assumes (UTC session, AQE, skew join).

    ``short_rows`` bounds the share of a task as well, for tables whose rows are many rather than long; without it the
    session has its own sizes again.
    """
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    own = _own_sizes.setdefault(spark.sparkContext.applicationId, {})
    for key, value in SHORT_ROWS_CONF.items():
        now = spark.conf.get(key, None)
        if short_rows and now != value:
            own[key] = now
            spark.conf.set(key, value)
        elif not short_rows and key in own:
            before = own.pop(key)
            if now == value:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark


_own_sizes: dict[str, dict[str, str | None]] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose executors
    share the driver's disk, may fall back to a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="agorametrics-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared root, never used before."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    For frames several branches of a plan read: the work is not repeated, the lineage is cut, the
    table outlives lost executors, and each branch scans only the columns it needs. ``codec`` is the files' compression,
    the session's own without it; ids as text take half the space with zstd.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").options(**({"compression": codec} if codec else {})).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append((path, back))
    return back


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """No rows of a schema, in one partition; no Python worker is asked for them."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).coalesce(1)


_open: list[list[tuple[str, DataFrame]]] = []


@contextmanager
def scratch():
    """Tables that ``materialize`` writes inside the block give their space back at its end, when the
    block's results must have been written or collected: each becomes an empty table. So do shuffles of the block, unless a
    variable still holds a frame whose rows were collected. The block's function leaves a table to the block around it."""
    around, made = _open[-1] if _open else [], []
    _open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        around.extend(x for x in made if x[1] is df)
        made[:] = [x for x in made if x[1] is not df]
        return df

    try:
        yield keep
    finally:
        _open.pop()
        for path, df in made:
            empty(df.sparkSession, df.schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        forget_shuffles()


def forget_shuffles() -> None:
    """Spark removes a shuffle's files when the driver's garbage collection finds its plan, which an idle heap puts off: ask for one."""
    gc.collect()
    if spark := SparkSession.getActiveSession():
        spark.sparkContext._jvm.System.gc()
