"""Mixing sources to target weights, by blocks of words.

The words of a source are packed into blocks of fixed length, its documents in the order
of a hash. The mix is a number of output shards with equally many slots. The slots of a
shard are drawn among the sources, independently and by the sources' quotas of blocks, so
the counts of a shard are a multinomial draw. What the draws of all shards together miss of
a quota is then settled: a source drawn too often gives up slots of each shard in
proportion, and sources drawn too rarely get them, dealt by a pseudorandom permutation. So
the mix holds each source's quota exactly. The slots of a source are numbered through all
shards; number j takes, in pass j div n over the source's n blocks, the block to which a
pseudorandom permutation of that pass maps j mod n. Slots and blocks are joined by index.

Targets: sources in order of their names' code points, the null source last, weigh
``weights`` in turn and share the words of all documents. No target is above ``most`` times
its source's words; what that leaves over is shared by weight among the others. As all
passes but the last take each block once, no document is taken more than ``most`` times.
What is taken of a source differs from its target by less than one and a half blocks.

Everything is built-in functions. Only rows of ids and sizes are shuffled to pack a source;
a source's documents are spread over many tasks, as offsets are added up per range of the
hash and then over the ranges. Draws are spread over tasks, whatever the sources' shares.
One task works on the table of sources (a row each) and on that of counts of one source (a
row per shard). The order, the draws and the permutations follow from hashes and ``seed``,
so reruns and other numbers of tasks give the same mix.

Nulls and texts without words have size 0 and are never taken. Repeated rows are packed one
after the other, each with what is taken of it. An empty table gives an empty one. Other
columns than key, text and source are not looked at. A very long text lies in many blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed, small_side
from leadlake.llm.text import WORD, let, words_of

WEIGHTS = (5, 2, 1)
#: Rounds of the permutation (swap-or-not: any number of elements, no walking of cycles).
ROUNDS = 24
#: Rows about which a range of the hash is made to hold.
RANGE_ROWS = 4096
#: Slots per exploded row and, up to ``MOST_TASKS``, per task.
CHUNK = 4096
TASK_SLOTS = 1 << 16
MOST_TASKS = 10_000
#: Pieces into which the sum of quotas is cut to find the source of a draw.
CELLS = 4096


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 … n - 1, one per ``key``.

    Swap-or-not: in each round x and its partner (the round's number less x) change places
    if a bit, hashed from the larger of both, says so.
    """

    def rounds(k: Column) -> Column:
        def turn(at: Column, r: Column) -> Column:
            def swapped(other: Column) -> Column:
                bit = F.xxhash64(k, r, F.greatest(at, other)).bitwiseAND(F.lit(1).cast("long"))
                return F.when(bit == 1, other).otherwise(at)

            return let(F.pmod(F.xxhash64(k, r) % n - at, n), swapped)

        return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), turn)

    return let(F.xxhash64(*key), rounds)


def _upto(*parts: str, order: Sequence) -> Window:
    return Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _before(c: str, window: Window) -> Column:
    return F.coalesce(F.sum(c).over(window), F.lit(0)).cast("long")


def sized(docs: DataFrame, key: str, text: str, source: str, *keep: Column) -> DataFrame:
    """(k, source, sk, size, h, keep…): one row per document. ``sk`` stands for the source and is never null."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    named = F.md5(F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")))
    order = F.shiftrightunsigned(F.xxhash64(key, text, source), 1)
    return docs.select(F.col(key).alias("k"), F.col(source).alias("source"), named.alias("sk"), size.alias("size"), order.alias("h"), *keep)


def with_targets(records: DataFrame, block: int, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row per source: (sk, i, source_size, target, blocks, quota).

    The fixed point of sharing the excess again and again: with the sources in order of cap
    per weight, those up to some place get their caps and the others equal shares per weight.
    """
    names = records.groupBy("sk").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    told = names.withColumn("i", rank).withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    by_cap = (F.col("cap") / F.col("w"), F.col("i"))
    capped, rest = _upto(order=by_cap), Window.orderBy(*by_cap).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - _before("cap", capped)) / F.sum("w").over(rest)
    told = told.withColumn("level", level)
    free = F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), "i", "level"))
    told = told.withColumn("share", F.min(free).over(every)["level"] * F.col("w"))
    told = told.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce("share", F.col("cap").cast("double"))))
    full = F.floor(F.col("target") / F.col("source_size"))
    part = F.round((F.col("target") - full * F.col("source_size")) / block).cast("long")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    quota = F.when(F.col("source_size") > 0, full * blocks + part).otherwise(0).cast("long")
    return told.select("sk", "i", "source_size", "target", blocks.alias("blocks"), quota.alias("quota"))


def with_offsets(records: DataFrame) -> DataFrame:
    """Add ``at``, the number of words of the source before each document with words.

    Documents go by (h, k, size). A task holds one range of the hash of one source; the
    number of ranges follows the number of rows and does not change the order.
    """
    some = records.where("size > 0")
    bits = max(0, (records.count() // RANGE_ROWS).bit_length())
    cut = some.withColumn("range", F.shiftright("h", 63 - bits) if bits else F.lit(0).cast("long"))
    inside = cut.withColumn("at", _before("size", _upto("sk", "range", order=("h", "k", "size"))))
    sums = cut.groupBy("sk", "range").agg(F.sum("size").alias("words"))
    starts = sums.select("sk", "range", _before("words", _upto("sk", order=("range",))).alias("start"))
    return inside.join(starts, ["sk", "range"]).withColumn("at", F.col("at") + F.col("start")).drop("range", "start")


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """Cut documents at the blocks' ends: one row per document and block, with ``block``, ``first`` (word) and ``words``."""
    start, end = F.col("at"), F.col("at") + F.col("size")
    cut = placed.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    low, high = F.greatest(start, F.col("block") * block), F.least(end, (F.col("block") + 1) * block)
    return cut.withColumn("first", low - start).withColumn("words", high - low)


def drawn_counts(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, i, n): how many slots of a shard each source is drawn for, one independent draw per slot."""
    spark = sources.sparkSession
    slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    width, per_shard = max(1, -(-slots // CELLS)), max(1, -(-slots // shards))
    ends = sources.where("quota > 0").select("i", _before("quota", _upto(order=("i",))).alias("low"), "quota")
    ends = ends.select("i", "low", (F.col("low") + F.col("quota")).alias("high"))
    cells = ends.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}L"), F.expr(f"(high - 1) div {width}L"))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, slots)).cast("long"))
    drawn = spark.range(slots).select(F.expr(f"id div {per_shard}L").cast("int").alias("shard"), draw.alias("g"))
    drawn = drawn.withColumn("cell", F.expr(f"g div {width}L"))
    owned = drawn.join(small_side(cells), "cell").where("g >= low and g < high")
    return owned.groupBy("shard", "i").agg(F.count("*").alias("n"))


def settled_counts(drawn: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Draws that add up to the quotas: (shard, i, n), at most one row per shard and source."""
    per = Window.partitionBy("i")
    known = drawn.join(small_side(sources.select("i", "quota")), "i").withColumn("all", F.sum("n").over(per))
    known = known.withColumn("old", _before("n", _upto("i", order=("shard",))))
    exact = [f"cast({c} as decimal(19, 0))" for c in ("quota", "old", "n", "`all`")]
    q, old, n, total = exact
    share = F.expr(f"cast(cast({q} * ({old} + {n}) as decimal(38, 0)) div {total} - cast({q} * {old} as decimal(38, 0)) div {total} as long)")
    kept = checkpointed(known.select("shard", "i", "n", F.when(F.col("all") > F.col("quota"), share).otherwise(F.col("n")).alias("stay")))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    freed = kept.groupBy("shard").agg(F.sum(F.col("n") - F.col("stay")).alias("free"))
    freed = freed.withColumns({"start": _before("free", _upto(order=("shard",))), "total": F.sum("free").over(every)})
    freed = freed.where("free > 0").select("shard", "total", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("free") - 1)).alias("x"))
    freed = freed.select("shard", permuted(F.col("x"), F.col("total"), F.lit(seed), F.lit(-1)).alias("y"))
    lack = sources.join(kept.groupBy("i").agg(F.sum("n").alias("had")), "i", "left")
    lack = lack.select("i", (F.col("quota") - F.coalesce("had", F.lit(0))).alias("lack")).where("lack > 0")
    lack = lack.withColumn("start", _before("lack", _upto(order=("i",))))
    lack = lack.select("i", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("lack") - 1)).alias("y"))
    given = freed.join(lack, "y").groupBy("shard", "i").agg(F.count("*").alias("stay"))
    both = kept.select("shard", "i", "stay").union(given.select("shard", "i", "stay"))
    return both.groupBy("shard", "i").agg(F.sum("stay").alias("n")).where("n > 0")


def slots(counts: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """The mix as an index: one row (shard, place, i, pass, block) per slot."""
    by_source = _before("n", _upto("i", order=("shard",)))
    by_shard = _before("n", _upto("shard", order=("i",)))
    whole = F.sum("n").over(Window.partitionBy("shard"))
    told = counts.select("shard", "i", "n", by_source.alias("j"), by_shard.alias("p"), whole.alias("whole"))
    chunks = told.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))))
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    # a number of tasks stated outright is not lowered for the few rows that become many here
    dealt = chunks.repartition(min(MOST_TASKS, max(1, -(-total // TASK_SLOTS))), "shard", "i", "chunk")
    last = F.least(F.col("n") - 1, F.col("chunk") * CHUNK + CHUNK - 1)
    each = dealt.withColumn("t", F.explode(F.sequence(F.col("chunk") * CHUNK, last))).join(small_side(sources.select("i", "blocks")), "i")
    each = each.withColumns({"pass": F.expr("(j + t) div blocks"), "nth": F.expr("(j + t) % blocks")})
    return each.select(
        "shard",
        permuted(F.col("p") + F.col("t"), F.col("whole"), F.lit(seed), F.lit(-2), F.col("shard")).alias("place"),
        "i",
        "pass",
        permuted(F.col("nth"), F.col("blocks"), F.lit(seed), F.col("i"), F.col("pass")).alias("block"),
    )


def _planned(records: DataFrame, shards: int, block: int, weights: Sequence[int], most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    sources = checkpointed(with_targets(records, block, weights, most))
    counts = checkpointed(settled_counts(drawn_counts(sources, shards, seed), sources, seed))
    return sources, slots(counts, sources, seed)


def mixture(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = 64, block: int = 64,
    weights: Sequence[int] = WEIGHTS, most: int = 3, seed: int = 11,
) -> DataFrame:
    """One row (key, source, size, source_size, target, taken) per document: what the mix takes of it."""
    records = checkpointed(sized(docs, key, text, source))
    sources, index = _planned(records, shards, block, weights, most, seed)
    named = small_side(sources.select("sk", "i", "source_size", "target"))
    cut = pieces(with_offsets(records), block).join(named, "sk")
    times = index.groupBy("i", "block").agg(F.count("*").alias("times"))
    row = ["k", "source", "size", "source_size", "target"]
    taken = cut.join(times, ["i", "block"], "left").groupBy(*row, "i", "at").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = records.where("size = 0").join(named, "sk").select(*row, F.lit(0).cast("long").alias("taken"))
    out = taken.select(*row, "taken").union(none)
    return out.select(F.col("k").alias(key), F.col("source").alias(source), *row[2:], "taken")


def packed(records: DataFrame, block: int) -> DataFrame:
    """(sk, block, words): the sources' blocks, from ``sized`` rows that keep their words as ``list``."""
    cut = pieces(with_offsets(records), block)
    part = F.struct("at", F.slice("list", (F.col("first") + 1).cast("int"), F.col("words").cast("int")).alias("x"))
    listed = cut.groupBy("sk", "block").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # at most ``block`` parts
    return listed.select("sk", "block", F.flatten(F.transform("parts", lambda p: p["x"])).alias("words"))


def mixed_blocks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = 64, block: int = 64,
    weights: Sequence[int] = WEIGHTS, most: int = 3, seed: int = 11,
) -> DataFrame:
    """The mix itself: one row (shard, place, source, block, words) per slot, in order of shard and place when sorted."""
    records = checkpointed(sized(docs, key, text, source))
    sources, index = _planned(records, shards, block, weights, most, seed)
    names = records.groupBy("sk").agg(F.max("source").alias("source")).join(sources.select("sk", "i"), "sk")
    blocks = packed(sized(docs, key, text, source, words_of(text).alias("list")), block).join(small_side(names), "sk")
    return index.join(blocks, ["i", "block"]).select("shard", "place", "source", "block", "words")
