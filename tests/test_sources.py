import random

import pytest
from pyspark.sql import functions as F

from leadlake.schema import TABLES, struct_type
from leadlake.sources import tables as S
from leadlake.sources.fixtures import CLOCK


def test_snapshot_versions(spark, t, tmp_path):
    lake = str(tmp_path / "lake")
    with pytest.raises(FileNotFoundError):
        S.load_tables(spark, lake)
    first = S.commit_snapshot(spark, lake, 1, t)
    assert set(first) == set(TABLES)
    assert first.leads.count() == t.leads.count()
    assert first.leads.schema == struct_type("leads")
    assert dict(first.doctors.dtypes)["consult_type"] == "array<string>"
    assert first.revenue.agg(F.sum("total_value")).first() == t.revenue.agg(F.sum("total_value")).first()
    # a later version replaces one table and keeps the others; the old version stays readable
    fewer = first.replace(leads=first.leads.where("lead_stage = 'customer'"))
    second = S.commit_snapshot(spark, lake, 2, fewer, ["leads"])
    assert second.leads.count() < first.leads.count() == S.load_tables(spark, lake, 1).leads.count()
    assert second.patients.count() == t.patients.count()
    assert S.committed_versions(spark, lake) == [1, 2]
    with pytest.raises(Exception, match="(?i)exists"):
        S.write_snapshot(t.leads, "leads", lake, 2)


def test_uncommitted_version_is_not_read(spark, t, tmp_path):
    lake = str(tmp_path / "lake")
    S.commit_snapshot(spark, lake, 1, t, ["users"])
    S.write_snapshot(t.users.limit(0), "users", lake, 2)
    assert S.load_tables(spark, lake).users.count() == t.users.count()


def test_clustered_files_have_disjoint_ranges(spark, t, tmp_path):
    folder = S.write_snapshot(t.leads, "leads", str(tmp_path), 1, cluster_by=["enquiry_date"])
    files = spark.read.parquet(folder).groupBy(F.input_file_name()).agg(
        F.min("enquiry_date").alias("a"), F.max("enquiry_date").alias("b")).orderBy("a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(files, files[1:]))


def test_defaults_and_ids(spark):
    df = spark.createDataFrame([("Ann", ""), ("Bob", "EXISTING ")], "full_name string, patient_type string")
    rows = S.apply_defaults(df.withColumn("primary_phone", F.lit("1")), "patients", CLOCK, blanks=True).collect()
    assert [r["patient_type"] for r in rows] == ["new", "existing"]
    assert len({r["id"] for r in rows}) == 2 and str(rows[0]["created_at"]) == CLOCK


def brute(target, rows, keys):
    taken = [{tuple(r[c] for c in key) for r in target} for key in keys]
    out = list(target)
    for r in sorted(rows, key=lambda r: r["seq"]):
        mine = [tuple(r[c] for c in key) for key in keys]
        if not any(m in s for m, s in zip(mine, taken)):
            out.append(r)
            for m, s in zip(mine, taken):
                s.add(m)
    return sorted((r["id"], r["u"]) for r in out)


def test_insert_ignore_with_several_keys_follows_the_sequence(spark):
    rng = random.Random(3)
    keys = [("id",), ("u",)]
    for _ in range(3):
        target = [{"id": i, "u": f"u{i}"} for i in range(4)]
        rows = [{"id": rng.randint(0, 14), "u": f"u{rng.randint(0, 14)}", "seq": i} for i in range(40)]
        got = S.insert_ignore(
            spark.createDataFrame([(r["id"], r["u"]) for r in target], "id bigint, u string"),
            spark.createDataFrame([(r["id"], r["u"], r["seq"]) for r in rows], "id bigint, u string, seq bigint"),
            keys, "seq")
        assert sorted(map(tuple, got.collect())) == brute(target, rows, keys)


@pytest.mark.parametrize("most", [S.COMPONENT_ROWS, 3])
def test_insert_ignore_with_nulls_and_small_components(spark, monkeypatch, most):
    monkeypatch.setattr(S, "COMPONENT_ROWS", most)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, *"abcdefgh"]), i) for i in range(30)]
    got = S.insert_ignore(
        spark.createDataFrame([], "id bigint, u string"), spark.createDataFrame(rows, "id bigint, u string, seq bigint"),
        [("id",), ("u",)], "seq")
    taken, want = (set(), set()), []
    for a, b, _ in rows:
        if a not in taken[0] and b not in taken[1]:
            want.append((a, b))
            taken[0].update([a] if a is not None else [])
            taken[1].update([b] if b is not None else [])
    order = lambda pairs: sorted(map(str, map(tuple, pairs)))
    assert order(got.collect()) == order(want)


def test_insert_ignore_of_a_long_chain_takes_few_checkpoints(spark, monkeypatch):
    from leadlake.functions import components as C

    made, plain = [], S.checkpointed
    for module in (S, C):
        monkeypatch.setattr(module, "checkpointed", lambda df: (made.append(1), plain(df))[1])
    n = 10_000
    chain = spark.range(n).select(F.floor((F.col("id") + 1) / 2).alias("id"), F.floor(F.col("id") / 2).alias("u"), F.col("id").alias("seq"))
    got = S.insert_ignore(spark.createDataFrame([], "id bigint, u bigint"), chain, [("id",), ("u",)], "seq")
    assert got.count() == n // 2 and got.select("id").distinct().count() == n // 2
    assert len(made) <= 40


def test_appending_writes_the_new_rows_only(spark, t, tmp_path):
    lake = str(tmp_path / "lake")
    S.commit_snapshot(spark, lake, 1, t, ["leads", "users"])
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "lake").rglob("*.parquet")}
    more = t.leads.limit(3).withColumn("id", F.concat(F.lit("new-"), F.col("id").cast("string")))
    third = S.commit_snapshot(spark, lake, 2, t, appended={"leads": more})
    assert third.leads.count() == t.leads.count() + 3 and third.users.count() == t.users.count()
    assert all(p.stat().st_mtime_ns == at for p, at in old.items())
    assert spark.read.parquet(f"{lake}/leads/version=2").count() == 3
    assert S.load_tables(spark, lake, 1).leads.count() == t.leads.count()
    whole = S.commit_snapshot(spark, lake, 3, t, ["leads"])
    assert whole.leads.count() == t.leads.count()
    with pytest.raises(ValueError):
        S.commit_snapshot(spark, lake, 4, t, ["leads"], {"leads": more})


def test_insert_ignore_text_keys(spark):
    target = spark.createDataFrame([(1, "Röntgen")], "id bigint, name string")
    rows = spark.createDataFrame([(2, "rontgen ", 1), (3, "New", 2), (4, "NEW", 3)], "id bigint, name string, seq bigint")
    assert sorted(r["id"] for r in S.insert_ignore(target, rows, [("name",)], "seq").collect()) == [1, 3]


def test_documents_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert S.to_documents(df).first()["value"] == '{"a":1,"b":null}'


def test_database_id_ranges_hold_every_id_once(spark):
    from leadlake.sources.jdbc import id_ranges

    ids = ["0a", "1", "19f", "9", "a0", "ffff", "lead-001", "Z", "", "f", "c3"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    hits = [df.where(p).count() for p in id_ranges()]
    assert sum(hits) == len(ids)
    assert df.where(" OR ".join(f"({p})" for p in id_ranges())).count() == len(ids)
