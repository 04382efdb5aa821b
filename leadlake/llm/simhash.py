"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text gets a 64-bit fingerprint: a bit is set if more than half of the hashes of
its word shingles have it set. Two fingerprints are linked if at most ``radius`` bits
differ. To find all links, every bit position is given a vector of radius + 1 binary
digits; each vector except zero names a table, whose mask keeps the positions with an
odd product. The positions in which two linked fingerprints differ span at most
``radius`` dimensions, so some table masks them all out: every linked pair meets in a
bucket of at least one of the 2^(radius + 1) - 1 tables.

Work is on distinct fingerprints, so copies cost nothing. In a bucket no pairs are
written: a star around a pivot joins most members at once, and only stars near each
other are compared further, until they are joined. Components are found from those
edges, which lose no link between different components.

Nulls and texts without words have fingerprint zero and are linked like any other.
Repeated rows share a component. An empty table stays empty. Rows with a null id take
part; a component's id is its smallest non-null id. Columns named like a result are
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed, small_side
from leadlake.llm.apart import Apart
from leadlake.llm.graph import components
from leadlake.llm.ship import ship_code

BITS = 64
SEED = 42
#: Members from which on a bucket is cut by another covering family, and how many times over.
LARGE_BUCKET = 512
FAMILIES = 3
#: Members up to which those of a part are compared one by one.
FEW = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of one whole text."""
    words = (text or "").encode().lower().split()  # of bytes: folds A-Z and cuts at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    last = min(width, len(words)) - 1
    for k in range(0, n, BLOCK):
        spans = zip(starts[k : min(n, k + BLOCK)].tolist(), ends[k + last : min(n, k + BLOCK) + last].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 4, out: str = "fp") -> DataFrame:
    """Add the fingerprint of each text as a signed 64-bit number. One pass, no shuffle."""
    ship_code(docs.sparkSession)

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x.as_py(), width) for x in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, prints(F.col(text)))


def covering_masks(radius: int, family: int = 0) -> list[int]:
    """Masks of the tables, as signed 64-bit numbers. Positions get their vectors from a fixed seed, one per ``family``."""
    rng = np.random.default_rng(SEED + family)
    size = 1 << (radius + 1)
    vectors = np.concatenate([rng.permutation(size) for _ in range(-(-BITS // size))])[:BITS]
    odd = [[bin(int(v) & table).count("1") & 1 for v in vectors] for table in range(1, size)]
    return [int(np.packbits(np.array(bits, np.uint8), bitorder="little").view(np.int64)[0]) for bits in odd]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the magnitude's bits


def bucket_edges(prints: np.ndarray, radius: int, family: int = 1) -> list[tuple[int, int]]:
    """Edges that join the members of a bucket exactly as all links between them would.

    A large bucket is cut by the tables of another covering family: its members agree in the bucket's
    bits, so they meet by others, and every linked pair still meets in some table.
    """
    if len(prints) <= LARGE_BUCKET or family > FAMILIES:
        return _star_edges(prints, radius)
    found = [np.empty((0, 2), np.int64)]
    for mask in covering_masks(radius, family):
        keys = prints & np.int64(mask)
        order = np.argsort(keys, kind="stable")
        group = np.concatenate(([0], np.cumsum(np.diff(keys[order]) != 0)))
        sizes = np.bincount(group)
        ends = np.cumsum(sizes)
        members = prints[order]
        # few members: each with those behind it, all groups at once
        at = np.nonzero(sizes[group] <= FEW)[0]
        for step in range(1, FEW):
            at = at[at + step < len(group)]
            at = at[group[at + step] == group[at]]
            if not at.size:
                break
            near = at[_differing(members[at], members[at + step]) <= radius]
            found.append(np.stack([members[near], members[near + step]], axis=1))
        for k in np.nonzero(sizes > FEW)[0].tolist():
            some = bucket_edges(members[ends[k] - sizes[k] : ends[k]], radius, family + 1)
            found.append(np.array(some, np.int64).reshape(-1, 2))
    return list(map(tuple, np.unique(np.concatenate(found), axis=0).tolist()))


def _star_edges(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges by stars around pivots; quadratic only in members that are far from each other."""
    rest, stars, edges = prints, [], []
    while len(rest):
        near = _differing(rest, rest[0]) <= radius
        star = rest[near]
        edges += [(int(star[0]), int(x)) for x in star[1:]]
        stars.append(star)
        rest = rest[~near]
    if len(stars) == 1:
        return edges
    pivots = np.array([s[0] for s in stars])
    root = np.arange(len(stars))
    for i, star in enumerate(stars):
        close = np.nonzero(_differing(pivots[i + 1 :], pivots[i]) <= 3 * radius)[0] + i + 1
        for j in close.tolist():
            if root[i] == root[j]:
                continue
            for x in star:
                if (hit := np.nonzero(_differing(stars[j], x) <= radius)[0]).size:
                    edges.append((int(x), int(stars[j][hit[0]])))
                    root[root == root[j]] = root[i]
                    break
    return edges


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of rows (table, bucket, fp) that come sorted; a bucket may go on in the next batch."""

    def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(3)]
        if held:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        table, bucket, fp = columns
        cuts = np.nonzero((table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1]))[0] + 1
        last = cuts[-1] if cuts.size else 0
        held = [c[last:] for c in columns]
        bounds = np.concatenate(([0], cuts))
        edges: list[tuple[int, int]] = []
        for k in np.nonzero(np.diff(bounds) > 1)[0]:
            edges += bucket_edges(fp[bounds[k] : bounds[k + 1]], radius)
        if edges:
            yield out(edges)
    if held and len(held[2]) > 1 and (edges := bucket_edges(held[2], radius)):
        yield out(edges)


def linked_fingerprints(prints: DataFrame, fp: str = "fp", radius: int = 4) -> DataFrame:
    """(fp, root): the component of every fingerprint that has a link to another one.

    One shuffle of distinct fingerprints times tables, by bucket. A bucket is worked on
    in one task; it holds distinct fingerprints that agree in half of their bits, 8 bytes
    each, however many rows have them.
    """
    ship_code(prints.sparkSession)
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    tables = prints.select(F.col(fp).alias("fp")).distinct().select("fp", F.posexplode(masks).alias("t", "mask"))
    buckets = tables.select(F.col("t").cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp")
    dealt = buckets.repartition("t", "bucket").sortWithinPartitions("t", "bucket", "fp")
    edges = dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")
    return components(edges).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (key, keep…, fp, root, component_id) per row of ``docs``.

    component_id is the smallest key reachable, root the smallest fingerprint reachable.
    """
    prints = checkpointed(with_fingerprints(docs.select(key, text, *keep), text, width).select(key, *keep, "fp"))
    roots = linked_fingerprints(prints, radius=radius)
    least = prints.groupBy("fp").agg(F.min(key).alias("_least")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = least.groupBy("root").agg(F.min("_least").alias("component_id")).join(least.select("fp", "root"), "root")
    return prints.join(named, "fp").select(key, *keep, "fp", "root", "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: that of smallest key (null last), then smallest text digest.

    Only keys and digests are grouped. Rows to leave out are looked up by both, so texts
    are not shuffled while there are few of them; of rows that are equal in both, one stays.
    """
    held = Apart(docs)
    key, text = held[key], held[text]
    tagged = held.df.withColumn("_d", F.md5(F.coalesce(text, F.lit(""))))
    found = near_duplicates(tagged, key, text, width, radius, ("_d",))
    each = checkpointed(found.groupBy("root", F.col(key).alias("_k"), F.col("_d").alias("_e")).agg(F.count("*").alias("_n")))
    place = F.struct(F.col("_k").isNull().alias("none"), F.col("_k").alias("k"), F.col("_e").alias("e"))
    best = each.groupBy("root").agg(F.min(place).alias("best"), F.count("*").alias("_rows"))
    told = each.join(best.where("_rows > 1"), "root", "left")
    first = F.col("best").isNull() | ((F.col("best")["e"] == F.col("_e")) & F.col("best")["k"].eqNullSafe(F.col("_k")))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_d") == F.col("_e"))
    rest = tagged.join(small_side(told.where(~first).select("_k", "_e")), same, "left_anti")
    repeated = small_side(told.where(first & (F.col("_n") > 1)).select("_k", "_e"))
    once = rest.join(repeated, same, "left_semi").dropDuplicates([key, "_d"])
    return held.back(rest.join(repeated, same, "left_anti").union(once))
