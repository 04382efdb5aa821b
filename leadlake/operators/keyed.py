"""Building blocks of the write jobs: checked intake, keyed update, upsert and delete.

Stored files have no row-level update, so each job states the new table as joins of
the old one with a batch, and the caller writes it as a new snapshot version.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.functions import semantics as S
from leadlake.functions.lookup import among
from leadlake.functions.reliability import small_side
from leadlake.operators.outcome import split_rejects
from leadlake.schema import ENUMS, REFERENCES, SETS, TABLES, not_null
from leadlake.sources.tables import Tables

MakeId = Callable[[str, Column], Column]
Rule = tuple[Column, str]


def stable_ids(salt) -> MakeId:
    """Ids that are the same whenever the plan is run again: a hash of table, batch and sequence."""
    return lambda table, seq: F.md5(F.concat_ws("|", F.lit(table), F.lit(str(salt)), seq.cast("string")))


def enum_rules(table: str, batch: DataFrame) -> list[Rule]:
    """Refuse values outside their domain (blank means the default and passes)."""
    rules = []
    for (name, column), domain in ENUMS.items():
        if name == table and column in batch.columns:
            bad = ~S.is_blank(column) & ~S.lower_value(F.col(column).cast("string")).isin(*domain)
            rules.append((bad, f"invalid {column}"))
    for (name, column), domain in SETS.items():
        if name == table and column in batch.columns:
            text = isinstance(batch.schema[column].dataType, T.StringType)
            items = F.split(F.col(column), ",") if text else F.col(column)
            rules.append((F.exists(items, lambda x: (x != "") & ~S.lower_value(x).isin(*domain)), f"invalid {column}"))
    return rules


_LARGE = {"patients", "leads", "interactions", "appointments", "revenue"}


def known_ids(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Target ids a batch names, as ``key`` with a ``_known`` mark. The batch's ids go to the
    target, and those found come back broadcast while they are few."""
    ids = small_side(among(target.select("id"), "id", batch.select(key)))
    return ids.select(F.col("id").alias(key), F.lit(True).alias("_known"))


def mark_known(batch: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """The batch with ``flag`` set where ``key`` is among ``ids``; blank keys are left unmarked.

    Most rows of a batch may leave a reference blank: these are dealt by their ``seq``, so that a
    join that shuffles does not send them all to one task.
    """
    spread = F.xxhash64("seq") if "seq" in batch.columns else F.lit(0).cast("bigint")
    side = small_side(ids.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("_deal"), F.lit(True).alias(flag)))
    dealt = batch.withColumn("_deal", F.when(S.is_blank(key), spread).otherwise(F.lit(0).cast("bigint")))
    return dealt.join(side, [key, "_deal"], "left").drop("_deal")


def empty_rules(table: str, batch: DataFrame, fields: Sequence[str]) -> list[Rule]:
    """Refuse what an update must not set: NULL where a value is required, and the empty
    text where a value list or a reference stands. Plain texts may be emptied."""
    needed, rules = not_null(table), []
    parents = {column for child, column, _ in REFERENCES if child == table}
    for c in fields:
        value = F.col(c).cast("string")
        if c in needed:
            rules.append((value.isNull(), f"{c} must not be empty"))
        if (table, c) in ENUMS:
            rules.append((value == "", f"invalid {c}"))
        if c in parents:
            rules.append((value == "", f"unknown {c}"))
    return rules


def reference_rules(t: Tables, table: str, batch: DataFrame) -> tuple[DataFrame, list[Rule], list[str]]:
    """Refuse references to rows that do not exist. Returns the batch with helper columns,
    the rules, and the helper columns to drop."""
    rules, helpers = [], []
    for child, column, parent in REFERENCES:
        if child == table and column in batch.columns:
            flag = f"_known_{column}"
            ids = t[parent].select("id")
            if parent in _LARGE:
                ids = among(ids, "id", batch.select(column))
            batch = mark_known(batch, ids, column, flag)
            rules.append((~S.is_blank(column) & F.col(flag).isNull(), f"unknown {column}"))
            helpers.append(flag)
    return batch, rules, helpers


def check_batch(
    t: Tables, table: str, batch: DataFrame, required: Sequence[str], text: str, *more: Rule, fresh: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Intake checks in the order: required fields, further rules, domains, references.

    With ``fresh``, given ids must be new: not in the table, nor in an earlier row of the batch.
    """
    order = batch.columns
    tagged, refs, helpers = reference_rules(t, table, batch)
    if fresh and "id" in batch.columns:
        first = batch.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("seq").alias("_first"))
        taken = known_ids(t[table], batch, "id").withColumnRenamed("_known", "_taken")
        tagged = tagged.join(small_side(first), "id", "left").join(taken, "id", "left")
        more = (*more, (F.col("_taken").isNotNull() | (F.col("seq") > F.col("_first")), "id is taken"))
        helpers = [*helpers, "_first", "_taken"]
    ok, bad = split_rejects(
        tagged, (S.any_blank(required), text), *more, *enum_rules(table, batch), *refs, once=True
    )
    return ok.select(*order), bad.drop(*helpers)


def require_row(
    target: DataFrame, batch: DataFrame, text: str, key: str = "id", once: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Refuse batch rows whose ``key`` is not in the target."""
    joined = batch.join(known_ids(target, batch, key), key, "left")
    ok, bad = split_rejects(joined, (F.col("_known").isNull(), text), once=once)
    return ok.drop("_known").select(*batch.columns), bad.drop("_known")


def join_rejects(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def typed(value: Column, table: str, column: str, target: DataFrame) -> Column:
    """A text value in the type and spelling a table column stores."""
    kind = target.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return F.split(value, ",")
    if not isinstance(kind, T.StringType):
        value = S.blank_to_null(value).try_cast(kind)
    if (table, column) in ENUMS:
        value = S.lower_value(value)
    return value


def with_changes(
    joined: DataFrame, names: Sequence[str], new: Mapping[str, Column], as_of
) -> DataFrame:
    """Set ``new`` values; ``updated_at`` moves only where a value really changed."""
    after = joined.select(
        *names, F.struct(*[v.alias(c) for c, v in new.items()]).alias("_after")
    )
    out = {c: F.col(f"_after.{c}") for c in new}
    if as_of is not None and "updated_at" in names:
        changed = F.lit(False)
        for c in new:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"_after.{c}"))
        out["updated_at"] = F.when(changed, S.moment(as_of)).otherwise(F.col("updated_at"))
    return after.withColumns(out).select(*names)


def update_rows(target: DataFrame, batch: DataFrame, new: Mapping[str, Column], as_of, key: str = "id") -> DataFrame:
    """Update target rows from a batch with one row per key. ``new`` may use target columns
    and batch columns (prefixed by ``b_``); rows without a match keep their values."""
    side = batch.select(
        F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"b_{c}") for c in batch.columns if c != key]
    )
    values = {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items()}
    return with_changes(target.join(small_side(side), key, "left"), target.columns, values, as_of)


def last_per_key(batch: DataFrame, keys: Sequence[Column | str], seq: str = "seq") -> DataFrame:
    return S.first_per_key(batch, keys, F.desc(seq))


def upsert(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], table: str, set_columns: Sequence[str], as_of
) -> DataFrame:
    """Insert rows with new keys, set ``set_columns`` of rows with known keys.

    ``rows`` is full width with one row per key. Keys compare without case, accents
    or trailing spaces; a known row keeps its own spelling.
    """
    match = [f"_k{i}" for i in range(len(keys))]
    old = target.select(
        F.struct(*target.columns).alias("old"), *[S.ci_key(k).alias(m) for k, m in zip(keys, match)]
    )
    new = rows.select(
        F.struct(*target.columns).alias("new"), *[S.ci_key(k).alias(m) for k, m in zip(keys, match)]
    )
    joined = old.join(new, match, "full_outer")
    fresh, given = F.col("old").isNull(), F.col("new").isNotNull()
    changed = F.lit(False)
    for c in set_columns:
        changed = changed | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    out = []
    for c in target.columns:
        if c in set_columns:
            value = F.when(given, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        elif c == "updated_at":
            value = F.when(fresh | (given & changed), S.moment(as_of)).otherwise(F.col("old.updated_at"))
        else:
            value = F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        out.append(value.alias(c))
    return joined.select(*out)


def without_ids(target: DataFrame, ids: DataFrame, key: str = "id", column: str = "id") -> DataFrame:
    """Rows whose ``column`` is not among ``ids[key]``."""
    gone = small_side(ids.select(F.col(key).alias(column)).distinct())
    return target.join(gone, column, "left_anti").select(*target.columns)


def column_kinds(table: str) -> dict[str, str]:
    return {c.name: c.kind for c in TABLES[table]}
