"""Text search by a posting index of three-letter pieces.

A scan compares every patient's name, phone and e-mail with the term. The index holds, for each
three-letter piece ("gram") of these texts, the patients that have it, sorted by gram in Parquet, so that a
look-up reads the row groups of its grams only. The lists of the term's rarest grams are intersected, and
the patients found are compared as the scan compares them, so both give the same rows.

The comparison ignores case, accents and trailing spaces. Texts of printable ASCII are indexed by their
lower-case form; patients with any other text stand in one list more, ``OTHERS``, which is read
with every look-up. Of a term, only stretches of printable ASCII are looked up. Two end marks behind
each text let one or two letters be looked up as the beginning of a gram.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.functions.lookup import among
from leadlake.functions.reliability import dealt, small_side
from leadlake.sources.tables import Tables, file_system

FIELDS = ("full_name", "primary_phone", "email")
#: Letters of a gram, and lists intersected at most: more hardly narrow the patients any further.
GRAM = 3
LISTS = 4
OTHERS = "?"
#: Rows a task cuts into grams: a few megabytes of names are one file, and some ten times as many postings.
ROWS = 50_000
_END = "\x03"
_PRINTABLE = r"^[\x20-\x7e]*$"


def _grams(text: Column) -> Column:
    """The grams of one text, none for null; ``OTHERS`` alone for a text that is not printable ASCII."""
    padded = F.concat(F.lower(text), F.lit(_END * (GRAM - 1)))
    own = F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(padded, k, F.lit(GRAM)))
    some = F.when(F.length(text) > 0, own).otherwise(F.array().cast("array<string>"))
    return F.when(text.isNull() | text.rlike(_PRINTABLE), some).otherwise(F.array(F.lit(OTHERS * (GRAM + 1))))


def postings(rows: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(gram, id): each different gram of a row's texts once. No shuffle."""
    every = F.flatten(F.array(*[_grams(F.col(c)) for c in fields]))
    return rows.select(F.explode(F.array_distinct(every)).alias("gram"), "id")


def asked_grams(term: str) -> tuple[list[str], list[str]]:
    """Whole grams and beginnings of grams that a printable text with the term in it must have."""
    whole, begun = [], []
    for run in re.findall(r"[\x20-\x7e]+", term.rstrip(" ").lower()):
        if len(run) >= GRAM:
            whole += [run[k : k + GRAM] for k in range(len(run) - GRAM + 1)]
        else:
            begun.append(run)
    return list(dict.fromkeys(whole)), begun


class SearchIndex:
    """Postings below ``path``: ``grams`` (gram, id) and ``counts`` (gram, n)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, rows: DataFrame) -> SearchIndex:
        """Index all rows for the first time."""
        self._append(rows)
        counts = self.grams().groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.path}/counts")
        return self

    def add(self, rows: DataFrame) -> SearchIndex:
        """Index new or changed rows. What is no longer so is found in vain, and the comparison drops it.

        Counts stay as they are: they only choose lists.
        """
        self._append(rows)
        return self

    def _append(self, rows: DataFrame) -> None:
        named = rows.select("id", *FIELDS)
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-named.count() // ROWS))
        # by gram, with the list of a very frequent gram split over many files
        laid = dealt(postings(named.repartition(tasks)), ["gram"]).sortWithinPartitions("gram", "id")
        laid.write.mode("append").option("parquet.bloom.filter.enabled#gram", "true").option(
            "parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{self.path}/grams")

    def exists(self) -> bool:
        fs, root = file_system(self.spark, f"{self.path}/counts/_SUCCESS")
        return fs.exists(root)

    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def rarest(self, whole: Sequence[str]) -> list[str]:
        """At most ``LISTS`` of the grams, rarest first; unknown ones are rarest of all."""
        known = self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(list(whole)))
        n = {r["gram"]: r["n"] for r in known.collect()}  # at most as many rows as the term has letters
        return sorted(whole, key=lambda g: (n.get(g, 0), g))[:LISTS]

    def candidates(self, term: str) -> DataFrame | None:
        """(id): patients that may have the term; None if the term leaves nothing to look up."""
        whole, begun = asked_grams(term)
        if not whole and not begun:
            return None
        grams = self.grams()
        if whole:
            chosen = self.rarest(whole)
            hit = grams.where(F.col("gram").isin(chosen)).distinct()  # added rows may repeat an entry
            met = hit.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen)).select("id")
        else:
            met = grams.where(F.col("gram").startswith(max(begun, key=len))).select("id")
        return met.union(grams.where(F.col("gram") == OTHERS * (GRAM + 1)).select("id")).distinct()


def search_patients(t: Tables, index: SearchIndex, term: str) -> DataFrame:
    """Patients whose name, phone or e-mail contains the term: those of :func:`listing.list_patients`."""
    found = index.candidates(term)
    rows = t.patients if found is None else among(t.patients, "id", found)
    return rows.where(S.search_any(list(FIELDS), term))


def search_leads(t: Tables, index: SearchIndex, term: str, **filters) -> DataFrame:
    """The lead list of the patients found: that of ``listing.list_leads(t, search=term)``.

    Leads are looked up by the patients, if these are few, before any name is joined.
    """
    from leadlake.operators.listing import filter_leads, list_leads

    people = search_patients(t, index, term)
    leads = among(filter_leads(t.leads, **filters), "patient_id", people.select("id"))
    return list_leads(t.replace(leads=leads, patients=small_side(people)))
