"""Reading, completing and writing the tables.

A lake is folders ``<path>/<table>/version=<n>`` plus ``<path>/_commits/<n>``, a
list of each table's folders that belong together: a changed table has one new
folder, one that rows were appended to has one more. A folder is never rewritten, and the commit is written last, so readers always see one
whole snapshot while a job writes the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.functions import semantics as S
from leadlake.functions.components import components
from leadlake.functions.reliability import checkpointed, fit_partitions
from leadlake.schema import AS_OF, ENUMS, SETS, TABLES, columns, has_id, spark_type, struct_type


#: Most rows that share keys, directly or by way of others, which one task decides on (a few numbers each).
COMPONENT_ROWS = 200_000

#: Name under which a frame for phone look-ups may stand among the tables of a job.
BY_PHONE = "patients_by_phone"


class Tables(Mapping):
    """The tables of one snapshot, as DataFrames, built when first used."""

    def __init__(self, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._frames = dict(frames)

    def __getitem__(self, name: str) -> DataFrame:
        frame = self._frames[name]
        if callable(frame) and not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def replace(self, **frames: DataFrame) -> Tables:
        return Tables({**self._frames, **frames})

    def built(self) -> list[DataFrame]:
        """The frames that have been built by now."""
        return [frame for frame in self._frames.values() if isinstance(frame, DataFrame)]


def with_total_value(df: DataFrame) -> DataFrame:
    """The computed column of ``revenue``: sum of its three parts."""
    total = F.col("consultation_value") + F.col("procedure_value") + F.col("package_value")
    return df.withColumn("total_value", total.cast("decimal(14,2)"))


def _default(col, as_of) -> Column:
    kind = spark_type(col.kind)
    if col.default is None:
        return F.lit(None).cast(kind)
    if col.default is AS_OF:
        return S.moment(as_of) if as_of is not None else F.lit(None).cast(kind)
    return F.lit(col.default).cast(kind)


def apply_defaults(
    df: DataFrame, table: str, as_of, new_id: Column | None = None, blanks: bool = False
) -> DataFrame:
    """Complete rows to the table's full width: ids, clock columns and value defaults.

    ``new_id`` fills missing ids (default: ``uuid()``, so materialise the result
    before reading it twice). With ``blanks`` the empty string counts as missing.
    """
    have = set(df.columns)
    enum_cols = {c for t, c in ENUMS if t == table}
    out = []
    for col in TABLES[table]:
        if col.name not in have:
            value = _default(col, as_of)
        else:
            value = F.col(col.name)
            if blanks and col.kind == "string":
                value = S.blank_to_null(value)
            if col.kind != "id":
                value = value.cast(spark_type(col.kind))
            if col.name in enum_cols:
                value = S.lower_value(value)
            if col.default is not None:
                value = F.coalesce(value, _default(col, as_of))
        if col.name == "id":
            made = F.expr("uuid()") if new_id is None else new_id
            value = F.coalesce(F.col("id"), made) if "id" in have else made
        out.append(value.alias(col.name))
    return df.select(*out)


def finish(df: DataFrame, table: str) -> DataFrame:
    """Computed parts every reader sees: revenue totals, consult types as an array."""
    if table == "revenue":
        return with_total_value(df)
    if table == "doctors" and isinstance(df.schema["consult_type"].dataType, T.StringType):
        return df.withColumn("consult_type", F.split("consult_type", ","))
    return df


def stored(df: DataFrame, table: str) -> DataFrame:
    """Inverse of :func:`finish`, in stored column order and types."""
    if table == "doctors" and isinstance(df.schema["consult_type"].dataType, T.ArrayType):
        df = df.withColumn("consult_type", F.array_join("consult_type", ","))
    return df.select(*[F.col(c.name).cast(spark_type(c.kind)).alias(c.name) for c in TABLES[table]])


def enum_violations(t: Tables) -> DataFrame:
    """Values outside their domain, with row counts: one row per (table, column, value).
    Each table is read once for all its columns."""
    out = None
    for table in dict.fromkeys(table for table, _ in ENUMS):
        faults = [
            F.when(
                ~F.col(column).isin(*domain),
                F.struct(F.lit(column).alias("column_name"), F.col(column).alias("value")),
            )
            for (name, column), domain in ENUMS.items() if name == table
        ] + [
            F.when(
                F.exists(column, lambda x: ~x.isin(*domain)  # noqa: B023
                ),
                F.struct(F.lit(column).alias("column_name"), F.array_join(column, ",").alias("value")),
            )
            for (name, column), domain in SETS.items() if name == table
        ]
        bad = (
            t[table]
            .select(F.inline(F.array_compact(F.array(*faults))))
            .groupBy(F.lit(table).alias("table_name"), "column_name", "value")
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        out = bad if out is None else out.unionByName(bad)
    return out


def file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Committed snapshot numbers, oldest first."""
    fs, root = file_system(spark, f"{path}/_commits")
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.isdigit() and fs.exists(done):
            found.append(int(name))
    return sorted(found)


#: Columns by which committed files are clustered, so that ranges of dates skip most of them.
CLUSTERS = {
    "leads": ("enquiry_date",), "interactions": ("interaction_date",), "appointments": ("appointment_date",), "revenue": ("billed_date",), "audit_logs": ("created_at",),
}


def _manifest(spark: SparkSession, path: str, version: int) -> dict[str, list[int]]:
    """The numbers of each table's folders, oldest first."""
    found: dict[str, list[int]] = {}
    for r in spark.read.schema("table string, version bigint").json(f"{path}/_commits/{version}").collect():
        found.setdefault(r["table"], []).append(r["version"])
    return {table: sorted(numbers) for table, numbers in found.items()}


def load_tables(spark: SparkSession, path: str, version: int | None = None) -> Tables:
    """One committed snapshot (the newest by default), with declared schemas."""
    if version is None:
        known = committed_versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no committed snapshot under {path}")
        version = known[-1]

    def reader(table: str, numbers: list[int]) -> Callable[[], DataFrame]:
        folders = [f"{path}/{table}/version={n}" for n in numbers]
        return lambda: finish(spark.read.schema(struct_type(table)).parquet(*folders), table)

    listed = _manifest(spark, path, version)
    fit_partitions(spark, [f"{path}/{table}/version={n}" for table, numbers in listed.items() for n in numbers])
    return Tables({name: reader(name, n) for name, n in listed.items()})


def write_snapshot(
    df: DataFrame, table: str, path: str, version: int, cluster_by: Sequence[str] = ()
) -> str:
    """Write one table of a new version; fails if that version folder exists.

    ``cluster_by`` range-partitions the rows so that the files' min/max statistics
    let later scans skip most of them.
    """
    folder = f"{path}/{table}/version={version}"
    out = stored(df, table)
    if cluster_by:
        out = out.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    out.write.mode("errorifexists").parquet(folder)
    return folder


def commit_snapshot(
    spark: SparkSession, path: str, version: int, t: Mapping[str, DataFrame], changed: Sequence[str] | None = None,
    appended: Mapping[str, DataFrame] | None = None,
) -> Tables:
    """Write the changed tables (all by default) as ``version`` and commit; others keep their folders.

    ``appended`` holds new rows of tables: only these are written, beside the folders the
    table has. With it, no table is changed by default.
    """
    appended = appended or {}
    if changed is None:
        changed = [] if appended else [table for table in t if table in TABLES]
    if both := set(changed) & set(appended):
        raise ValueError(f"both changed and appended to: {sorted(both)}")
    known = committed_versions(spark, path)
    manifest = _manifest(spark, path, known[-1]) if known else {}
    for table in changed:
        write_snapshot(t[table], table, path, version, CLUSTERS.get(table, ()))
        manifest[table] = [version]
    for table, rows in appended.items():
        write_snapshot(rows, table, path, version, CLUSTERS.get(table, ()))
        manifest[table] = [*manifest.get(table, []), version]
    listed = sorted((table, n) for table, numbers in manifest.items() for n in numbers)
    rows = spark.createDataFrame(listed, "table string, version bigint")
    rows.coalesce(1).write.mode("errorifexists").json(f"{path}/_commits/{version}")
    return load_tables(spark, path, version)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[Sequence[str]], seq: str) -> DataFrame:
    """Append ``rows`` in ``seq`` order, skipping each row that meets a key already taken.

    ``keys`` lists the unique keys (each a column tuple). Text keys compare
    without case, accents or trailing spaces. Numbers in ``seq`` are unique.
    """
    def match(df: DataFrame, key: Sequence[str]) -> list[Column]:
        text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
        return [S.ci_key(c) if c in text and c != "id" else F.col(c) for c in key]

    def without(left: DataFrame, right: DataFrame) -> DataFrame:
        for key in keys:
            names = [f"_k{i}" for i in range(len(key))]
            taken = right.select(*[c.alias(n) for c, n in zip(match(right, key), names)])
            tagged = left.select("*", *[c.alias(n) for c, n in zip(match(left, key), names)])
            left = tagged.join(taken, names, "left_anti").drop(*names)
        return left

    rest = without(rows, target)
    if len(keys) == 1:
        fresh = S.first_per_key(rest, match(rest, keys[0]), F.col(seq))
        return target.unionByName(fresh.select(*target.columns))

    accepted = _first_come(rest, [match(rest, key) for key in keys], seq)
    return target.unionByName(rows.join(accepted, seq, "left_semi").select(*target.columns))


def _first_come(rows: DataFrame, keys: Sequence[Sequence[Column]], seq: str) -> DataFrame:
    """Numbers (``seq``) of the rows accepted if each is refused that shares a key with an earlier accepted one.

    A key's value goes by the number of the first row that has it. A row that is first in all
    its keys is accepted, those behind it in a key are refused; what is left falls into
    components of rows that share keys, each decided in order by one task from its numbers
    alone. Components of more than ``COMPONENT_ROWS`` rows go through another round first.
    A key with a NULL in it is shared with no row: its row alone is its first.
    """
    names = [f"_f{j}" for j in range(len(keys))]
    tagged = rows.select(F.col(seq).cast("bigint").alias("_seq"), *[c.alias(f"_k{j}_{i}") for j, key in enumerate(keys) for i, c in enumerate(key)])
    for j, key in enumerate(keys):
        parts = [f"_k{j}_{i}" for i in range(len(key))]
        first = tagged.dropna(subset=parts).groupBy(*parts).agg(F.min("_seq").alias(f"_f{j}"))
        tagged = tagged.join(first, parts, "left").withColumn(f"_f{j}", F.coalesce(f"_f{j}", "_seq"))
    rest = checkpointed(tagged.select("_seq", *names))
    accepted = rest.select("_seq").limit(0)
    while True:
        ready = checkpointed(rest.where(F.least(*names) == F.col("_seq")).select("_seq"))
        accepted = accepted.union(ready)
        for f in names:
            rest = rest.join(ready.select(F.col("_seq").alias(f)), f, "left_anti")
        rest = checkpointed(rest.join(ready, "_seq", "left_anti").select("_seq", *names))
        if rest.isEmpty():
            return accepted.withColumnRenamed("_seq", seq)
        rest = _firsts_again(rest, names)
        edges = rest.select("_seq", F.explode(F.array(*names)).alias("_first")).where("_seq != _first")
        rooted = rest.join(components(edges, "_seq", "_first").withColumnRenamed("node", "_seq"), "_seq", "left")
        rooted = checkpointed(rooted.withColumn("root", F.coalesce("root", "_seq")))
        large = checkpointed(rooted.groupBy("root").count().where(F.col("count") > COMPONENT_ROWS).select("root"))
        decided = rooted.join(large, "root", "left_anti").groupBy("root").applyInPandas(_in_order, "_seq bigint")
        accepted = accepted.union(checkpointed(decided))
        rest = checkpointed(rooted.join(large, "root", "left_semi").select("_seq", *names))


def _firsts_again(rest: DataFrame, names: Sequence[str]) -> DataFrame:
    """The first rows of all keys among those left."""
    for f in names:
        first = rest.groupBy(f).agg(F.min("_seq").alias("_first"))
        rest = rest.join(first, f).drop(f).withColumnRenamed("_first", f)
    return checkpointed(rest.select("_seq", *names))


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one component that no earlier accepted one shares a key with."""
    rows = rows.sort_values("_seq")
    held = [rows[c].tolist() for c in rows.columns if c.startswith("_f")]
    taken, kept = [set() for _ in held], []
    for n, *values in zip(rows["_seq"].tolist(), *held):
        if not any(v in t for v, t in zip(values, taken)):
            kept.append(n)
            for v, t in zip(values, taken):
                t.add(v)
    return pd.DataFrame({"_seq": pd.Series(kept, dtype="int64")})


def to_documents(df: DataFrame) -> DataFrame:
    """One JSON text per row, fields with NULL kept: ready for ``write.text``."""
    return df.select(
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    )


__all__ = [
    "Tables", "apply_defaults", "columns", "commit_snapshot", "committed_versions",
    "enum_violations", "finish", "has_id", "insert_ignore", "load_tables", "stored",
    "to_documents", "with_total_value", "write_snapshot",
]
