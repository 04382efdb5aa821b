"""Running numbers that no single task has to compute alone.

A plain ``row_number()`` sends all rows of a key (or, with no key, all rows) to
one task. Here the sequence is cut into slices that hold about equally many rows:
rows are numbered inside their (key, slice), slice totals are added up per key, and both
are joined. Cuts are quantiles of the sequence, so a slice is no larger because other
numbers lie far away. A (key, slice) pair holds at most a slice's rows, whatever share
of the data one key has. A frame that the optimizer knows to be small is one slice and costs no
extra pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows per slice, as long as no more than ``MOST_SLICES`` are needed.
SLICE_ROWS = 1_000_000
MOST_SLICES = 1024
#: Quantiles are exact to one part in so many.
ACCURACY = 16 * MOST_SLICES
#: Frames estimated below this size are one slice.
SMALL_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; very large if nothing is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cut_points(df: DataFrame, seq: str, rows: int | None = None) -> list[int]:
    """First numbers of all slices but the first: at most ``MOST_SLICES - 1``, in order.

    One small job, none for a frame known to be small. Given ``rows`` (per slice), always one.
    """
    if rows is None and estimated_bytes(df) < SMALL_BYTES:
        return []
    shares = F.array(*[F.lit(k / MOST_SLICES) for k in range(1, MOST_SLICES)])
    told = df.agg(F.count(seq).alias("n"), F.percentile_approx(F.col(seq).cast("bigint"), shares, ACCURACY).alias("cuts")).first()
    wanted = min(MOST_SLICES, -(-told["n"] // (rows or SLICE_ROWS)))
    return sorted({told["cuts"][round(k * MOST_SLICES / wanted) - 1] for k in range(1, wanted)})


def slice_of(seq: str, cuts: Sequence[int]) -> Column:
    """Slice number of a whole-number sequence column: how many cuts are not above it.

    Cuts are looked through in two steps, so that few of them are compared.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    value = F.col(seq).cast("bigint")

    def upto(numbers: Column) -> Column:
        return F.size(F.filter(numbers, lambda c: c <= value))

    def listed(numbers: Sequence[int]) -> Column:
        return F.array(*[F.lit(n).cast("bigint") for n in numbers])

    group = upto(listed([g[0] for g in groups]))
    inside = upto(F.element_at(F.array(*[listed(g) for g in groups]), F.greatest(group, F.lit(1))))
    return F.when(group == 0, 0).otherwise((group - 1) * step + inside)


def running_number(
    df: DataFrame, seq: str, keys: Sequence[str] = (), out: str = "n", rows: int | None = None
) -> DataFrame:
    """Add ``out`` = 1, 2, 3, … in ``seq`` order, per key combination (or over all rows)."""
    cuts = cut_points(df, seq, rows)
    if not cuts:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(seq)))
    # Stated outright: rows that arrive partitioned by the keys alone would otherwise stay so,
    # and a key with very many rows would stay in one task.
    cut = df.withColumn("_slice", slice_of(seq, cuts)).repartition(*keys, "_slice")
    inside = Window.partitionBy(*keys, "_slice").orderBy(seq)
    numbered = cut.withColumn("_inside", F.row_number().over(inside))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*keys, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        numbered.join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_slice", "_inside", "_before")
    )
