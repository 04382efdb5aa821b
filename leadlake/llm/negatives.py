"""Hard-negative mining with Four-Russians scores.

Vectors become whole numbers, and each candidate is stored as bit planes (two's
complement): one byte per plane and group of eight dimensions. For an anchor and a group,
the sums of all 256 subsets of its eight components are put into a table; a plane's byte
picks the sum of the components whose bit is set. A score is the planes' sums, doubled and
added from the sign plane down: the full inner product, exact.

The anchors (a stated part of the rows) meet all rows in blocks: a cell of the grid is one
block of anchors and one of candidates, both of bounded size and dealt by hash, whatever
labels or vectors are frequent. A cell gives back, per anchor, at most ``positives`` or
``negatives`` per threshold; window ranks (cut before the shuffle too) merge the cells. The
first pass over the grid finds each anchor's positives, the second, with their scores as
thresholds, the negatives. No score is kept between them.

Rows with a null label or vector or with a component that is null or not finite take no
part. Vectors of other lengths count as filled up with zeros, so an empty one scores 0.
Rows with the anchor's own id are not its others; repeated rows each count. Among equal
scores the smaller id comes first, a null id last. An empty table gives an empty one. Other
columns are not looked at. Components must be below 2^31 in size after scaling, and sums of
products below 2^56: larger ones are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed
from leadlake.llm.ship import ship_code

#: Anchors and candidates of one cell, about.
ANCHORS = 1024
CANDIDATES = 2048
#: Anchors whose tables are in use at once (512 bytes of 4-byte sums per anchor and plane group).
AT_ONCE = 64


def whole_vectors(vectors: DataFrame, key: str, vector: str, label: Column | str, scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part; v holds floor(scale * x)."""
    kept = vectors.select(F.col(key).alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = kept.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(fine)
    return kept.select("id", "label", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(np.int64)] = flat
    return out


def bit_planes(rows: np.ndarray, planes: int) -> np.ndarray:
    """(n, planes, groups) bytes; bit k of a byte is the plane's bit of the group's component k."""
    bits = (rows[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of a group's eight components."""
    groups = anchors.shape[1] // 8
    tables = np.zeros((groups, 256, len(anchors)), kind)
    parts = anchors.T.reshape(groups, 8, len(anchors))
    for k in range(8):
        tables[:, 1 << k : 2 << k] = tables[:, : 1 << k] + parts[:, k, None, :]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products, by look-ups, doublings and additions only."""
    picked = np.empty((planes.shape[0], tables.shape[2]), tables.dtype)
    total = np.zeros_like(picked)
    top = planes.shape[1] - 1
    for plane in range(top, -1, -1):
        total += total
        for group in range(tables.shape[0]):
            np.take(tables[group], planes[:, plane, group], axis=0, out=picked, mode="clip")
            if plane == top:  # the sign plane counts below zero
                total -= picked
            else:
                total += picked
    return total


def _ranked(cands: pa.Table, anchors: pa.Table, shape: tuple[int, int]):
    """Per anchor: its place in ``anchors``, the candidates' places from best to worst, and their scores."""
    planes, groups = shape
    bytes_ = np.frombuffer(b"".join(cands["planes"].to_pylist()), np.uint8).reshape(-1, planes, groups)
    rows = _matrix(anchors["v"], groups * 8)
    most = int(np.abs(rows).sum(axis=1).max()) << planes
    kind = np.int32 if most < 1 << 31 else np.int64
    for start in range(0, len(rows), AT_ONCE):
        found = scores(subset_sums(rows[start : start + AT_ONCE], kind), bytes_).T
        orders = np.argsort(-found, axis=1, kind="stable")
        for k, order in enumerate(orders):
            yield start + k, order, found[k][order]


def _by_id(cands: pa.Table) -> pa.Table:
    return cands.sort_by("id")  # nulls last


class Grid:
    """Candidates and anchors in cells of bounded size."""

    def __init__(self, rows: DataFrame, is_anchor: Column):
        spark = rows.sparkSession
        ship_code(spark)
        size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x.cast("long")), F.lit(1).cast("long")))
        told = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("v")), F.max(size)).first()
        n, n_anchors, dims, largest = (x or 0 for x in told)
        if largest * largest * dims >= 1 << 56:
            raise ArithmeticError("components too large for exact scores")
        self.shape = (planes, groups) = int(largest).bit_length() + 1, max(1, -(-dims // 8))

        def pack(batches):
            for b in batches:
                stored = bit_planes(_matrix(b["v"], groups * 8), planes).reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array([r.tobytes() for r in stored], pa.binary())], ["id", "label", "planes"])

        cells, blocks = -(-n // CANDIDATES) or 1, -(-n_anchors // ANCHORS) or 1
        stored = checkpointed(rows.mapInArrow(pack, "id long, label long, planes binary"))
        every_block, every_cell = (F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (blocks, cells))
        self.candidates = stored.withColumn("cell", F.pmod(F.xxhash64("id", "planes"), F.lit(cells)).cast("int")).withColumn("block", every_block)
        distinct = rows.where(is_anchor).dropDuplicates(["id", "label", "v"])
        self.anchors = checkpointed(distinct.withColumn("anchor", F.monotonically_increasing_id()))
        self._cell, self._block = every_cell, F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")

    def over(self, anchors: DataFrame, work, schema: str) -> DataFrame:
        """``work(candidates by id, anchors, shape)`` of every cell."""
        shape, out = self.shape, pa.schema([pa.field(c.split()[0], pa.int64()) for c in schema.split(", ")])

        def one(cands: pa.Table, anchors: pa.Table) -> pa.Table:
            found = work(_by_id(cands), anchors, shape) if len(cands) and len(anchors) else []
            return pa.table([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [[]] * len(out), out)

        dealt = anchors.withColumn("block", self._block).withColumn("cell", self._cell)
        return self.candidates.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInArrow(one, schema)


def _best(found: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` per key as ``rank`` 1, 2, …: higher scores, then smaller ids, first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
) -> DataFrame:
    """Per anchor and positive the hardest negatives whose score is between ``low`` and ``high`` percent of the positive's.

    ``is_anchor`` is a condition on ``id``, the name that the key has here. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = checkpointed(whole_vectors(vectors, key, vector, label, scale))
    grid = Grid(rows, is_anchor)

    def nearest(cands: pa.Table, anchors: pa.Table, shape: tuple[int, int]):
        ids, labels = cands["id"].to_pylist(), cands["label"].to_numpy()
        own = np.array([i if i is not None else -1 for i in ids], np.int64)
        nulls = np.array([i is None for i in ids])
        names, numbers, wanted = (anchors[c].to_pylist() for c in ("id", "anchor", "label"))
        for a, order, found in _ranked(cands, anchors, shape):
            same = np.nonzero((labels[order] == wanted[a]) & ((own[order] != names[a]) | nulls[order]))[0][:positives]
            for at in same.tolist():
                yield numbers[a], names[a], ids[order[at]], int(found[at])

    schema = "anchor long, anchor_id long, id long, score long"
    first = _best(grid.over(grid.anchors, nearest, schema), positives, "anchor")
    first = checkpointed(first.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    def hardest(cands: pa.Table, anchors: pa.Table, shape: tuple[int, int]):
        ids, labels = cands["id"].to_pylist(), cands["label"].to_numpy()
        numbers, wanted, limits = (anchors[c].to_pylist() for c in ("anchor", "label", "limits"))
        for a, order, found in _ranked(cands, anchors, shape):
            others = labels[order] != wanted[a]
            order, found = order[others], found[others].astype(np.int64)
            for limit in limits[a]:
                # 100 * score <= high * limit holds from here on, as scores fall
                start = int(np.searchsorted(-found * 100, -high * limit, "left"))
                for at in range(start, min(start + negatives, len(found))):
                    if low * limit > 100 * found[at]:
                        break
                    yield numbers[a], limit, ids[order[at]], int(found[at])

    limits = first.groupBy("anchor").agg(F.collect_set("positive_score").alias("limits"))  # at most ``positives`` each
    told = grid.over(grid.anchors.join(limits, "anchor"), hardest, "anchor long, positive_score long, id long, score long")
    last = _best(told, negatives, "anchor", "positive_score")
    named = first.join(last, ["anchor", "positive_score"])
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
