"""Quality rules: fixed rules and robust multivariate outliers per language and source.

Statistics of each whole text are turned into a vector of rates. For each group of
language and source, location and scatter are estimated by minimum covariance
determinant: of all halves of the group's texts, that whose scatter has the smallest
determinant is looked for. A concentration step takes the half nearest in Mahalanobis
distance to an estimate and estimates anew. Every start of ``STARTS`` takes
``FIRST_STEPS`` steps; the start with the smallest determinant goes on until its
determinant falls no more. Rows far from their group's estimate are rejected.
Estimates count each different text of a group once, so copies of one text weigh no
more than the text.

The scatter is regularised: squared floors are added to its variances, within the
determinant that is compared as well, for which concentration steps are known to
lower it too (Boudt, Rousseeuw, Vanduffel and Verdonck, The minimum regularized
covariance determinant estimator, 2020). The half is exact: of the bin of distances
that it ends in, every text weighs the share that belongs to it.

Everything is built-in functions. Only the statistics, a few numbers a row, are kept
and read again. Order statistics per group come from counts over fine bins, so a group
with a third of all rows is counted map-side and no task sees all its rows; distances
are worked out by a Cholesky factor written out in columns.

Nulls and empty texts have no words and fail the fixed rules. Null languages and
sources are groups of their own. Groups of fewer than ``LEAST_ROWS`` texts take the
estimate of all rows. Repeated rows are judged alike. An empty table stays empty.
Columns named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed, is_small
from leadlake.llm.apart import Apart
from leadlake.llm.text import let, places, words_of

WINDOW = 8
#: Fixed rules: fewest words, and the highest share of repeated words in percent.
FEWEST_WORDS, MOST_REPEATED = 20, 30
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")
#: What copies of a text are told by, beside the statistics.
DIGEST = "_text_hash"


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash comes twice or more; windows start at every word but the last ones."""

    def covered(starts: Column) -> Column:
        step = lambda acc, k: acc + F.least(F.lit(WINDOW), F.get(starts, k + 1) - F.get(starts, k))
        return F.aggregate(places(F.size(starts)), F.lit(0), step)

    def among(ordered: Column) -> Column:
        same = lambda k, d: F.get(ordered, k + d)["h"].eqNullSafe(F.get(ordered, k)["h"])
        again = F.filter(places(F.size(ordered)), lambda k: same(k, -1) | same(k, 1))
        return let(F.sort_array(F.transform(again, lambda k: F.get(ordered, k)["at"])), covered)

    ordered = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, among))


def _window_hashes(words: Column) -> Column:
    """64-bit hashes of all windows; equal windows have equal hashes, and two different ones of a text
    share one with a chance of under 1 in 10^9 for texts of 100,000 words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    window = lambda hs: F.transform(places(F.size(hs) - (WINDOW - 1)), lambda k: F.xxhash64(*[F.get(hs, k + d) for d in range(WINDOW)]))
    return let(hashed, window)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``STATISTICS`` (long) and the ``DIGEST`` of each whole text. One pass, no shuffle."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumns({"_words": words_of(text), "_lines": lines}).withColumn("_windows", _window_hashes(F.col("_words")))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated(F.col("_windows")),
        "n_upper": F.regexp_count(whole, F.lit("[A-Z]")),
    }
    return counted.withColumns({k: v.cast("long") for k, v in counts.items()} | {DIGEST: F.xxhash64(whole)}).drop("_words", "_lines", "_windows")


#: Rates of a text's vector, and the standard deviation that is always allowed for: a group
#: in which a rate never varies must not reject the first text in which it does a little.
RATES = {
    "ln(word_chars / n_words)": 0.12,
    "ln(1 + n_symbols / n_words)": 0.04,
    "ln(1 + n_dup_lines / sqrt(n_words))": 0.08,
    "n_repeat_words / n_words": 0.08,
    "n_upper / word_chars": 0.03,
}
P = len(RATES)
FLOORS = list(RATES.values())
#: The estimate covers (n + P + 1) / 2 of a group's n texts, which breaks down last. The factor makes
#: its scatter that of all texts of a normal group: 1/2 over the chance of a chi-square of P + 2
#: degrees up to the median of one of P degrees.
CONSISTENCY = 1.912
#: First scatters about the medians, all with median absolute deviations as scale: without
#: correlations, with those of tanh of the scaled rates, with those of their directions.
STARTS = ("scale", "tanh", "direction")
FIRST_STEPS = 2
#: A group is at rest once a step lowers the logarithm of its determinant by less.
REST = 0.01
LEAST_ROWS = 50
#: Rows beyond this squared distance are rejected: the quantile of chi-square of P degrees at
#: 1 - 1.4e-8, so that a normal group of ten million texts loses none of its own more often than
#: one time in seven.
CUTOFF = 45.0
ALL = "*"
SALTS = 64
BINS = 8


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _group() -> Column:
    return F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")))


def _vector() -> Column:
    words, chars = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars"))
    rates = [F.log(chars / words), F.log1p(F.col("n_symbols") / words), F.log1p(F.col("n_dup_lines") / F.sqrt(words)), F.col("n_repeat_words") / words, F.col("n_upper") / chars]
    return F.array(*[r.cast("double") for r in rates])


def _half(rows: DataFrame, keys: list[str], bin_: str, more: int = 0) -> DataFrame:
    """Per keys, the first bin (as ``bin_``) up to which half of the rows and ``more`` lie, the ``share`` of its rows
    that belong to that half, and the number ``n`` of rows."""
    counts = rows.groupBy(*keys, bin_).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.select(*keys, bin_, F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(Window.partitionBy(*keys)).alias("n"), "_n")
    half = F.least("n", F.floor((F.col("n") + more + 1) / 2))
    ends = summed.select(*keys, "n", "_upto", half.alias("_half"), F.struct(bin_, ((half - F.col("_upto")) / F.col("_n") + 1).alias("share")).alias("_end"))
    return ends.where("_upto >= _half").groupBy(*keys).agg(F.min("_end").alias("_end"), F.max("n").alias("n")).select(*keys, f"_end.{bin_}", "_end.share", "n")


def _medians(rows: DataFrame) -> DataFrame:
    """(g, center): the median of each place of ``x`` per group, as the middle of a bin a fraction of the floor wide."""
    width = F.get(F.array(*[F.lit(f / BINS) for f in FLOORS]), F.col("i"))
    binned = rows.select("g", F.posexplode("x").alias("i", "v")).select("g", "i", F.floor(F.col("v") / width).alias("bin"))
    middle = _half(binned, ["g", "i"], "bin").select("g", F.struct("i", ((F.col("bin") + 0.5) * width).alias("m")).alias("at"))
    return middle.groupBy("g").agg(F.transform(F.sort_array(F.collect_list("at")), lambda a: a["m"]).alias("center"))


def _distance(center: str = "center", factor: str = "factor") -> Column:
    """Squared Mahalanobis distance by forward substitution with the rows of a Cholesky factor."""

    def solve(y: Column, i: int) -> Column:
        if i == P:
            return F.aggregate(y, F.lit(0.0), lambda a, v: a + v * v)
        rest = F.get("x", i) - F.get(center, i)
        for j in range(i):
            rest = rest - F.get(factor, i * P + j) * F.get(y, j)
        return let(F.concat(y, F.array(rest / F.get(factor, i * P + i))), lambda z: solve(z, i + 1))

    return solve(F.array().cast("array<double>"), 0)


def _per_row(rows: DataFrame, table: DataFrame, how: str = "inner", on: tuple[str, ...] = ("g",)) -> DataFrame:
    """Join rows with a table of few rows per group.

    The table is broadcast if it is measured to be small. Otherwise rows are dealt by group
    and salt, as a group may hold any share of them.
    """
    kept = checkpointed(table)
    if is_small(kept):
        return rows.join(F.broadcast(kept), list(on), how)
    spread = kept.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(spread, [*on, "_salt"], how).drop("_salt")


def _with_factor(moments: DataFrame) -> DataFrame:
    """Turn covariances c<i>_<j> into ``factor``, the rows of the lower Cholesky factor, and ``logdet``, their determinant's logarithm.

    Materialised, as the formulas written out are long and must not be put into those that use them.
    """
    cell: dict[tuple[int, int], Column] = {}
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            moments = moments.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
            cell[i, j] = F.col(f"l{i}_{j}")
    logdet = 2 * sum((F.log(cell[i, i]) for i in range(P)), F.lit(0.0))
    rows = F.array(*[cell.get((i, j), F.lit(0.0)) for i in range(P) for j in range(P)])
    return checkpointed(moments.select("g", "start", "n", "center", rows.alias("factor"), logdet.alias("logdet")))


def _starts(rows: DataFrame) -> DataFrame:
    """(g, start, n, center, factor, logdet): the first estimates of every group, one row per group and start."""
    medians = checkpointed(_medians(rows))
    away = _per_row(rows, medians).select("g", F.zip_with("x", "center", lambda v, m: F.abs(v - m)).alias("x"))
    scale = F.transform("center", lambda m: 1.4826 * m).alias("scale")
    around = checkpointed(medians.join(_medians(away).select("g", scale), "g"))
    floors = F.array(*[F.lit(f) for f in FLOORS])
    scaled = F.transform("x", lambda v, i: (v - F.get("center", i)) / F.sqrt(F.pow(F.get("scale", i), 2) + F.pow(F.get(floors, i), 2)))
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v))
    signs = _per_row(rows, around).select("g", "center", "scale", scaled.alias("z")).select(
        "g", "center", "scale", F.transform("z", F.tanh).alias("tanh"),
        F.transform("z", lambda v: v / F.greatest(length, F.lit(1e-12))).alias("direction"),
    )
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = signs.groupBy("g").agg(
        F.first("center").alias("center"), F.first("scale").alias("scale"),
        *[F.avg(F.get(s, i) * F.get(s, j)).alias(f"{s}{i}_{j}") for s in STARTS[1:] for i, j in pairs],
    )

    def covariance(start: str, i: int, j: int) -> Column:
        if i == j:
            return F.pow(F.get("scale", i), 2) + F.lit(FLOORS[i] ** 2)
        if start == "scale":
            return F.lit(0.0)
        own = F.sqrt(F.greatest(f"{start}{i}_{i}", F.lit(1e-12)) * F.greatest(f"{start}{j}_{j}", F.lit(1e-12)))
        return F.get("scale", i) * F.get("scale", j) * F.col(f"{start}{i}_{j}") / own

    first = [F.struct(F.lit(s).alias("start"), *[covariance(s, i, j).alias(f"c{i}_{j}") for i, j in pairs]) for s in STARTS]
    return _with_factor(sums.select("g", F.lit(0).cast("long").alias("n"), "center", F.explode(F.array(*first)).alias("_c")).select("g", "n", "center", "_c.*"))


def _concentrated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One concentration step of every estimate; groups that ``found`` does not name are left out."""
    at = found.select("g", "start", F.col("center").alias("old"), "factor")
    far = _per_row(rows, at).select("g", "start", "x", "old", F.floor(F.log1p(_distance("old")) * 64).alias("bin"))
    edge = _half(far, ["g", "start"], "bin", P).withColumnRenamed("bin", "edge")
    near = _per_row(far, edge, on=("g", "start")).where("bin <= edge")
    weight = F.when(F.col("bin") < F.col("edge"), 1.0).otherwise(F.col("share"))
    off = [F.get("x", i) - F.get("old", i) for i in range(P)]
    mean = lambda v: F.sum(weight * v) / F.sum(weight)
    sums = near.groupBy("g", "start").agg(
        F.max("n").alias("n"), F.max("old").alias("old"), *[mean(off[i]).alias(f"m{i}") for i in range(P)],
        *[mean(off[i] * off[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1)],
    )
    covariances = [
        (CONSISTENCY * (F.col(f"s{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}")
        for i in range(P) for j in range(i + 1)
    ]
    center = F.array(*[F.get("old", i) + F.col(f"m{i}") for i in range(P)]).alias("center")
    return _with_factor(sums.select("g", "start", "n", center, *covariances))


def estimates(stats: DataFrame) -> DataFrame:
    """(g, start, n, center, factor, logdet): the robust estimate of every group and of all rows together.

    ``stats`` has the columns of ``with_statistics`` and lang and source; rows that fail
    the fixed rules do not count, and copies of a text count once per group. The result
    has one row per group: of all estimates met, that with the smallest determinant.
    """
    texts = stats.where(~base_failed()).select(F.explode(F.array(_group(), F.lit(ALL))).alias("g"), DIGEST, *STATISTICS).distinct()
    rows = checkpointed(texts.select("g", _vector().alias("x")))
    found = _starts(rows)
    for _ in range(FIRST_STEPS):
        found = _concentrated(rows, found)
    whole = F.struct("logdet", "start", "n", "center", "factor")
    best = checkpointed(found.groupBy("g").agg(F.min(whole).alias("_e")).select("g", "_e.*"))
    moving = best
    while True:
        before = best.select("g", F.col("logdet").alias("_before"))
        after = _concentrated(rows, moving)
        moving = checkpointed(after.join(before, "g").where(F.col("logdet") < F.col("_before") - REST).select(*best.columns))
        if moving.isEmpty():
            return best
        best = checkpointed(best.join(moving.select("g"), "g", "left_anti").unionByName(moving))


def judged(stats: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``distance`` (squared) and ``kept`` to rows of statistics.

    A row whose group has fewer than ``LEAST_ROWS`` different texts is held against all rows.
    """
    large = found.where((F.col("n") >= LEAST_ROWS) | (F.col("g") == ALL))
    marked = stats.withColumns({"base_failed": base_failed(), "x": _vector(), "g": _group()})
    named = _per_row(marked, large.select("g", F.lit(True).alias("_large")), "left")
    marked = named.withColumn("g", F.when(F.col("_large"), F.col("g")).otherwise(ALL)).drop("_large")
    scored = _per_row(marked, large.select("g", "center", "factor"), "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return scored.withColumn("kept", kept).drop("g", "x", "center", "factor", DIGEST)


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass both the fixed rules and their group's estimate, with their columns."""
    held = Apart(docs)
    rows = held.df.withColumns({c: F.col(held[c]) for c in ("lang", "source")})
    stats = checkpointed(with_statistics(rows.select("lang", "source", held[text]), held[text]).select("lang", "source", DIGEST, *STATISTICS))
    found = estimates(stats)
    return held.back(judged(with_statistics(rows, held[text]), found).where("kept"))
