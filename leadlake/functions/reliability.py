"""Cutting lineage in a way that survives losing executors."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast if it is proven to have at most so many rows and bytes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20

#: A stored megabyte takes several in a shuffle, and more when sorted: a shuffle starts with a
#: partition per so many stored bytes, of which adaptive execution joins small ones up to ``TASK_BYTES``.
STORED_BYTES = 4 << 20
TASK_BYTES = 16 << 20
MOST_PARTITIONS = 8192
#: Most stored bytes that one task reads: rows on their way to a shuffle are held uncompressed.
SCAN_BYTES = 32 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    scratch = _SCRATCH.get()
    if scratch is not None:
        scratch.made |= checkpoints_read([out]) or set()
    return out


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more. It learns of them when
    the driver collects garbage, which a driver with memory to spare may not do for long."""
    gc.collect()
    spark._jvm.System.gc()


#: Leaves of plans that read no checkpoint.
_OTHER_LEAVES = {"LogicalRelation", "LocalRelation", "OneRowRelation", "Range", "CTERelationRef"}
#: Steps that cost no more than reading what is below them.
_CHEAP_STEPS = {"Project", "Filter", "Union", "LogicalRDD", "LocalRelation"}


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def checkpoints_read(frames: Iterable[DataFrame]) -> set[str] | None:
    """The checkpoint folders that frames read, or None if that cannot be told."""
    found = set()
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        for leaf in [leaf for p in [plan, *_listed(plan.subqueriesAll())] for leaf in _listed(p.collectLeaves())]:
            kind = leaf.getClass().getSimpleName()
            file = leaf.rdd().getCheckpointFile() if kind == "LogicalRDD" else None
            if file is not None and file.isDefined():
                found.add(file.get())
            elif kind not in _OTHER_LEAVES:
                return None
    return found


_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


class Scratch:
    """Keeps track of the checkpoints made inside a ``with`` block, to delete them when they have served.

    Otherwise they stay as long as the application, or until the driver happens to collect its
    garbage, and a job's intermediate rows take several times the room of its tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, set()

    def __enter__(self) -> Scratch:
        self._token = _SCRATCH.set(self)
        return self

    def __exit__(self, *_) -> None:
        _SCRATCH.reset(self._token)

    def sweep(self, *kept: DataFrame) -> None:
        """Delete the checkpoints made so far that no frame of ``kept`` reads, or none if that cannot be
        told. Frames that read them, and are not named, cannot be used any more."""
        read = checkpoints_read(kept)
        for file in self.made - read if read is not None else ():
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(file)
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
            self.made.discard(file)
        reclaim(self.spark)

    def holds(self, df: DataFrame) -> bool:
        """Whether ``df`` only picks rows and columns of checkpoints made here: another one would be a copy."""
        plan = df._jdf.queryExecution().optimizedPlan()
        steps, cheap = [plan], plan.deterministic()
        while steps and cheap:
            step = steps.pop()
            cheap = step.getClass().getSimpleName() in _CHEAP_STEPS
            steps += _listed(step.children())
        read = checkpoints_read([df]) if cheap else None
        return read is not None and read <= self.made


def fit_partitions(spark: SparkSession, paths: Iterable[str]) -> None:
    """Let shuffles start with as many partitions as the files below ``paths`` call for.

    With a fixed number a task's share, and the memory its sorts take, grows with the input. The
    number is only raised, and sizes the session was given, for joined partitions or for the
    part of a file that one task reads, are left alone.
    """
    stored = 0
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(jpath):
            stored += fs.getContentSummary(jpath).getLength()
    wanted = min(MOST_PARTITIONS, -(-stored // STORED_BYTES))
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if wanted > int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(first, str(wanted))
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.files.maxPartitionBytes": SCAN_BYTES}
    for key, size in sizes.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(size))


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys side by side for writing, in partitions of the advised size: large keys are split, small ones joined.

    Ranges would need a sample, for which all that ``df`` still has to work out is done twice.
    """
    return df.hint("rebalance", *keys)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a frame cut to ``rows`` rows, if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def is_small(kept: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a materialised frame has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes (of its values as JSON)."""
    line = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept.columns])))
    n, size = kept.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(line.cast("bigint")), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_BYTES


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise ``df`` and broadcast it if it is proven to be small in rows and in bytes.

    A larger frame gets the hint that makes the join shuffle: estimates come from compressed
    files and pruned columns, and may take millions of ids for a few megabytes.
    """
    return sized_side(checkpointed(df), rows)


def sized_side(kept: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised frame as a join's side: broadcast if it is measured to be small, else shuffled."""
    return F.broadcast(kept) if is_small(kept, rows) else kept.hint("merge")
