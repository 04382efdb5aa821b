"""Benchmark decontamination by a distributed positional inverted index.

A window is ``width`` consecutive words of a benchmark item, or a shorter item as a
whole. Windows are searched as phrases in a positional index of the training texts:
term frequencies over all texts tell which two places of each window hold its rarest
terms; the postings of those terms (text, place) are stored; lists are adjusted by the
places' offsets and intersected, so that only alignments of an item with a text in
which both rare terms stand right are left. Those are compared word by word.
``proximity`` returns the looser matches: all alignments in which rare terms stand at
most ``slack`` places off.

Texts are indexed by a digest of their words' text, so copies share postings and hot
texts do not multiply. Only postings of terms that some window asks for are shuffled.
Everything is built-in functions. The benchmark's terms and places and the digests of
hit texts are broadcast only after their rows have been counted (``small_side``);
larger ones are joined by shuffles, whose skewed partitions Spark splits.

Nulls and texts without words have no words, no hits and are clean. Items that are null
or without words have no windows; items with a null id mark words as hit but are not
listed or counted. Repeated items count once. Repeated rows get the same result each.
Empty tables give empty results, or clean ones. Columns named like a result are
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed, small_side
from leadlake.llm.apart import Apart
from leadlake.llm.text import matches, places, spans

#: Words of the index: anything but ASCII characters that are no digits or letters.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: str | Column) -> Column:
    """A text with A-Z in lower case, the empty text for null."""
    return F.coalesce(F.translate(text, UPPER, LOWER), F.lit(""))


def terms(text: str | Column) -> Column:
    return matches(folded(text), TERM)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def item_windows(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(item, words, first, long): distinct items with words, one row per window with its first place."""
    told = items.select(F.col(item).alias("item"), terms(text).alias("words")).where(F.size("words") > 0).distinct()
    size = F.least(F.size("words"), F.lit(width))
    return told.withColumn("long", size).select("item", "words", "long", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("long"))).alias("first"))


def rare_places(windows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(item, words, long, p1, p2): for each window the places in its item of its two rarest terms.

    Frequencies are counted over all texts, for the windows' terms only. Windows with the
    same two places are one row; a window of one word has the same place twice.
    """
    asked = small_side(windows.select(F.explode("words").alias("term")).distinct())
    told = docs.select(F.explode(terms(text)).alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    windows = windows.withColumn("told", _told())
    items = windows.select("told", "words").distinct()
    ranked = items.select("told", "words", F.posexplode("words").alias("at", "term")).join(told, "term", "left")
    counts = ranked.groupBy("told", "words").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("counts"))
    inside = F.transform(F.slice("counts", F.col("first") + 1, F.col("long")), lambda c: F.struct(c["n"], c["at"]))
    two = windows.join(counts, ["told", "words"])  # the item itself may be null
    two = two.withColumn("rarest", F.slice(F.sort_array(inside), 1, 2))
    p1, p2 = F.get("rarest", F.lit(0))["at"], F.get("rarest", F.size("rarest") - 1)["at"]
    return two.select("item", "words", "long", F.least(p1, p2).alias("p1"), F.greatest(p1, p2).alias("p2")).distinct()


def postings(docs: DataFrame, anchors: DataFrame, text: str) -> DataFrame:
    """(term, digest, at): the stored index of all texts, for the terms the anchors ask for."""
    asked = small_side(anchors.select(F.explode(F.array(F.get("words", F.col("p1")), F.get("words", F.col("p2")))).alias("term")).distinct())
    told = docs.select(_digest(text).alias("digest"), F.posexplode(terms(text)).alias("at", "term"))
    return checkpointed(told.join(asked, "term", "left_semi").select("term", "digest", "at").distinct())


def alignments(index: DataFrame, anchors: DataFrame, slack: int = 0) -> DataFrame:
    """(digest, told, shift): where both rare terms of a window of the item ``told`` stand right.

    Each list is shifted by its term's place in the item; ``shift`` is the text's place of
    the item's first word. With ``slack``, the second term may be that many places off.
    Items and places go by hashes here, so that rows are short; two with one hash would
    only be compared in vain.
    """
    rows = anchors.withColumn("told", _told()).withColumn("pair", F.xxhash64("told", "p1", "p2"))
    one = lambda p: rows.select(F.get("words", F.col(p)).alias("term"), "pair", F.col(p).alias("p"), F.lit(p == "p2").alias("second"))
    hit = index.join(small_side(one("p1").union(one("p2"))), "term").withColumn("shift", F.col("at") - F.col("p"))
    if slack:
        hit = hit.withColumn("shift", F.explode(F.when(F.col("second"), F.sequence(F.col("shift") - slack, F.col("shift") + slack)).otherwise(F.array("shift"))))
    both = hit.groupBy("digest", "pair", "shift").agg(F.max("second").alias("b"), F.min("second").alias("a")).where("b and not a")
    return both.join(small_side(rows.select("pair", "told").distinct()), "pair").select("digest", "told", "shift").distinct()


def _told() -> Column:
    return F.xxhash64("item", "words")


def proximity(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13, slack: int = 3) -> DataFrame:
    """(digest, item, shift): alignments whose rare terms stand at most ``slack`` places off."""
    anchors = checkpointed(rare_places(item_windows(items, item, item_text, width), docs, text))
    named = small_side(anchors.select(_told().alias("told"), "item").distinct())
    return alignments(postings(docs, anchors, text), anchors, slack).join(named, "told").select("digest", "item", "shift").distinct()


def _runs(own: Column, words: Column, shift: Column, long: Column) -> Column:
    """Runs of at least ``long`` places in which the text's words are the item's: (start, end) in the text."""
    same = F.transform(places(F.size(words)), lambda k: F.when(F.get(own, shift + k).eqNullSafe(F.get(words, k)), "1").otherwise("0"))
    found = F.filter(spans(F.array_join(same, ""), "1++"), lambda s: s["end"] - s["start"] >= long)
    return F.transform(found, lambda s: F.struct((shift + s["start"]).alias("start"), (shift + s["end"]).alias("end")))


def exact_hits(docs: DataFrame, found: DataFrame, anchors: DataFrame, text: str) -> DataFrame:
    """(digest, item, start, end): stretches of words of texts that occurrences of an item's windows cover."""
    near = docs.select(_digest(text).alias("digest"), text).join(small_side(found.select("digest").distinct()), "digest", "left_semi")
    own = near.dropDuplicates(["digest"]).select("digest", terms(text).alias("own"))
    items = small_side(anchors.select(_told().alias("told"), "item", "words", "long").distinct())
    compared = own.join(found.join(items, "told"), "digest").select("digest", "item", F.explode(_runs(F.col("own"), F.col("words"), F.col("shift"), F.col("long"))).alias("r"))
    return compared.select("digest", "item", "r.start", "r.end").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13, share: int = 20
) -> DataFrame:
    """Add n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated to each row of ``docs``.

    A text is contaminated if at least one in ``share`` of its words is hit.
    """
    held = Apart(docs)
    docs, text = held.df, held[text]
    items = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    anchors = checkpointed(rare_places(item_windows(items, "item_id", "text", width), docs, text))
    found = checkpointed(alignments(postings(docs, anchors, text), anchors))
    hits = checkpointed(exact_hits(docs, found, anchors, text))
    earlier = Window.partitionBy("digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    stretches = hits.select("digest", "start", "end").distinct().withColumn("upto", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    covered = stretches.groupBy("digest").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "upto"), F.lit(0))).alias("n_hit"))
    listed = hits.where("item is not null").groupBy("digest").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
    told = small_side(covered.join(listed, "digest", "left").withColumnRenamed("digest", "_digest"))
    out = docs.withColumn("n_words", F.size(terms(text)).cast("long")).withColumn("_key", _digest(text)).join(told, F.col("_key") == F.col("_digest"), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    told = out.withColumns({"n_hit": hit, "item_ids": ids})
    enough = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return held.back(told, {"n_words": "n_words", "n_hit": "n_hit", "n_items": F.size("item_ids").cast("long"), "item_ids": "item_ids", "contaminated": enough})


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated (see :func:`contamination`), with all their columns as they were."""
    held = Apart(docs)
    return held.back(contamination(held.df, items, held[text], **options).where(~F.col("contaminated")))
