from pyspark.sql import functions as F

from leadlake.operators import dedupe as M
from leadlake.operators import integrity as I
from leadlake.operators import profiles as P

PEOPLE = "id bigint, full_name string, primary_phone string, created_at timestamp_ntz"


def people(spark, t, rows):
    df = spark.createDataFrame(rows, "id bigint, full_name string, primary_phone string").withColumn(
        "created_at", F.expr("timestamp_ntz'2001-01-01'"))
    return t.replace(patients=df)


def test_phone_forms(spark, t):
    c = people(spark, t, [(1, "a", "ext. none"), (2, "b", "--"), (3, "c", "123"), (4, "d", "+91 98765-43210"),
                          (5, "e", "0098765 43210"), (6, "f", "12 3")])
    got = {}
    for r in M.duplicates_by_phone(c).collect():
        got.setdefault(r["key"], set()).add(r["id"])
    assert got == {"": {1, 2}, "123": {3, 6}, "76543210": {4, 5}}


def test_equal_groups_are_reported_once(spark, t):
    c = people(spark, t, [(1, "Ann", "100"), (2, " ann ", "100"), (3, "Bob", "200"), (4, "BOB", "200"), (5, "bob", "300"),
                          (6, "x", "200")])
    groups = {}
    for r in M.duplicate_groups(c).collect():
        groups.setdefault((r["type"], r["key"]), set()).add(r["id"])
    assert groups == {("name", "ann"): {1, 2}, ("name", "bob"): {3, 4, 5}, ("phone", "200"): {3, 4, 6}}


def test_accents_do_not_split_a_group(spark, t):
    c = people(spark, t, [(1, "José", "1"), (2, "jose ", "2"), (3, "JOSÉ", "3")])
    assert M.duplicates_by_name(c).count() == 3


def test_only_the_largest_groups(spark, t):
    rows = [(i, f"n{i // 2}", str(i)) for i in range(20)] + [(100, "n0", "x")]
    got = M.duplicates_by_name(people(spark, t, rows), n=2)
    assert {r["key"] for r in got.collect()} == {"n0", "n1"}
    assert M.duplicates_by_name(people(spark, t, rows), n=None).select("key").distinct().count() == 10


def test_a_large_group_is_split_into_whole_parts(spark, t):
    rows = [(i, "same name", "0") for i in range(500)] + [(900, "other", "1"), (901, "other", "1")]
    docs = M.duplicate_documents(people(spark, t, rows), part_rows=50).collect()
    big = [d for d in docs if d["key"] == "same name"]
    assert len(big) == big[0]["parts"] == 10
    assert sorted(i for d in big for i in d["ids"]) == list(range(500))
    assert [d["parts"] for d in docs if d["key"] == "other"] == [1]


def test_profile_parts_hold_every_child_once(t):
    whole = {r["lead_id"]: r for r in P.lead_360(t).collect()}
    assert all(r["parts"] == 1 for r in whole.values())
    seen = {}
    for r in P.lead_360(t, part_rows=2).collect():
        for name in ("interactions", "appointments", "revenue"):
            times = [x[0] for x in r[name]]
            assert times == sorted(times, reverse=True)
            seen.setdefault((r["lead_id"], name), []).extend(x["id"] for x in r[name])
    for (lead, name), ids in seen.items():
        assert sorted(ids) == sorted(x["id"] for x in whole[lead][name])


def mapping(spark, pairs):
    return spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(pairs)], "seq bigint, secondary_id bigint, primary_id bigint")


def test_chains_resolve_and_cycles_are_refused(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    done, cyclic = M.resolve_mapping(mapping(spark, chain + [(100, 101), (101, 102), (102, 100), (103, 100), (7, 999), (5, 5)]))
    assert {r["secondary_id"]: r["primary_id"] for r in done.collect()} == {i: 40 for i in range(1, 40)}
    assert {r["secondary_id"] for r in cyclic.collect()} == {100, 101, 102, 103}


def test_many_secondaries_of_one_primary(spark):
    done, cyclic = M.resolve_mapping(mapping(spark, [(i, 0) for i in range(1, 300)] + [(0, 1000)]))
    assert {r["primary_id"] for r in done.collect()} == {1000} and done.count() == 300 and cyclic.count() == 0


def test_merge_keeps_all_facts_and_references(spark, t):
    some = [r["id"] for r in t.patients.orderBy("id").limit(9).collect()]
    pairs = [(some[1], some[0]), (some[2], some[1]), (some[3], some[3]), (some[4], -5), (some[5], some[6]), (some[6], some[5])]
    done = M.merge_patients(t, mapping(spark, pairs))
    for name in ("leads", "appointments", "revenue"):
        assert done.tables[name].count() == t[name].count()
        moved = done.tables[name].where(F.col("patient_id").isin(some[1], some[2])).count()
        assert moved == 0
    assert done.tables.patients.count() == t.patients.count() - 2
    assert I.fk_violations(done.tables).count() == 0
    assert {r["reason"] for r in done.rejects.collect()} == {
        "primary is among the secondaries", "primary patient not found", "merge cycle"}
