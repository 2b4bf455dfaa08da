"""Session set-up and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest numbers of rows and of bytes that are ever handed to a broadcast hint.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "ordinalis", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with AQE on; `master` and `shuffle_partitions` are only set when given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only on a local master where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ordinalis-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def store_root(spark: SparkSession) -> str:
    """Folder of the store that the registered queries share: of this session only, so that each session does its own work.

    A job that wants to keep results between sessions gives `Store` a folder of its own.
    """
    return f"{shared_dir(spark).rstrip('/')}/store"


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: what its texts and arrays hold, and a fixed part for each column."""
    total = F.lit(0)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        size = F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 24 if kind.startswith(("array", "map")) else F.lit(0)
        total = total + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 16
    return total


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Settle an aggregated table and mark it for broadcast only if it is really small, in rows and in bytes.

    Larger tables come back unmarked, so the join falls to AQE (sort-merge with skew splitting).
    """
    limit = BROADCAST_ROWS if limit is None else limit
    settled = settle(df)
    rows, size = settled.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(settled)), F.lit(0))).first()
    return F.broadcast(settled) if rows <= limit and size <= BROADCAST_BYTES else settled
