"""Joins and tasks at sizes that estimates get wrong."""

import os

from pyspark.sql import functions as F

from leadlake.functions import reliability
from leadlake.functions.lookup import POINTS, among
from leadlake.functions.reliability import BROADCAST_ROWS, small_side
from leadlake.operators import search
from leadlake.operators.keyed import mark_known
from leadlake.operators.writes import update_leads
from leadlake.plans.inspect import plan_text
from leadlake.sources import fixtures, partitioned, tables


def test_a_side_measured_as_large_is_not_broadcast_by_its_estimate(spark):
    batch = spark.range(10).withColumn("x", F.lit(1))
    for df in (batch.join(small_side(spark.range(1000), rows=100), "id", "left"), batch.join(small_side(spark.range(1000), rows=100), "id", "left_anti")):
        assert "Broadcast" not in plan_text(df)
    assert "BroadcastHashJoin" in plan_text(batch.join(small_side(spark.range(1000)), "id", "left"))


def test_many_values_looked_up_are_not_broadcast_by_their_estimate(spark):
    many = spark.range(BROADCAST_ROWS + POINTS)
    found = among(spark.range(50).withColumn("x", F.lit(1)), "id", many)
    assert "Broadcast" not in plan_text(found) and found.count() == 50


def test_blank_references_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr("leadlake.functions.reliability.is_small", lambda *_: False)
    batch = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") % 100 == 0, F.col("id")).alias("doctor_id"))
    ids = spark.range(0, 500).where("id % 200 = 0")
    marked = mark_known(batch, ids, "doctor_id", "_known")
    assert {r["seq"] for r in marked.where("_known").collect()} == {0, 200, 400} and marked.count() == 1000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = [r["n"] for r in mark_known(batch, ids, "doctor_id", "_known").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(per_task) == 8 and max(per_task) < 300


def test_patches_join_directories_without_one_task_for_absent_fields(spark, t, monkeypatch):
    monkeypatch.setattr("leadlake.functions.reliability.is_small", lambda *_: False)
    fields = F.create_map(F.lit("campaign_name"), F.lit("x"))
    patch = t.leads.select("id", F.col("id").alias("seq"), fields.alias("fields"))
    done = update_leads(t, patch, "2001-08-01 00:00:00")
    assert done.accepted.count() == t.leads.count() and done.rejects.isEmpty()


def test_shuffles_start_with_partitions_that_the_stored_files_call_for(spark, tmp_path, monkeypatch):
    first, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    path = str(tmp_path / "rows")
    spark.range(10000).write.parquet(path)
    held = {key: spark.conf.get(key, None) for key in (first, size)}
    monkeypatch.setattr(reliability, "STORED_BYTES", 1000)
    try:
        spark.conf.unset(first)
        spark.conf.unset(size)
        reliability.fit_partitions(spark, [str(tmp_path / "none")])
        assert spark.conf.get(first, None) is None and spark.conf.get(size) == str(reliability.TASK_BYTES)
        spark.conf.set(size, "8m")
        reliability.fit_partitions(spark, [path])
        assert int(spark.conf.get(first)) > 30 and spark.conf.get(size) == "8m"
        spark.conf.set(first, "5000")
        reliability.fit_partitions(spark, [path])
        assert spark.conf.get(first) == "5000"
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_readers_size_shuffles_by_what_they_read(spark, t, tmp_path, monkeypatch):
    asked = []
    for module in (fixtures, tables, partitioned):
        monkeypatch.setattr(module, "fit_partitions", lambda _, paths: asked.append(list(paths)))
    fixtures.load_fixture(spark, "/root/testdata/sf0.001")
    tables.commit_snapshot(spark, str(tmp_path / "lake"), 1, t, ["facilities"])
    partitioned.PartitionedLake(spark, str(tmp_path / "months"), fixtures.spark_schema, t).create(t, ["facilities"]).tables()
    assert [len(paths) for paths in asked] == [8, 1, 1] and asked[2][0].endswith("/months/facilities")


def test_a_task_reads_no_more_of_a_file_in_larger_tables(spark, tmp_path, monkeypatch):
    most = "spark.sql.files.maxPartitionBytes"
    held = {key: spark.conf.get(key, None) for key in (most, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    monkeypatch.setattr(reliability, "SCAN_BYTES", 20_000)
    per_task = []
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")  # as few tasks as a much larger table would get
        for copies in (1, 6):
            path = str(tmp_path / f"rows{copies}")
            spark.range(copies * 20_000).repartition(copies * 10).write.parquet(path)
            spark.conf.unset(most)
            reliability.fit_partitions(spark, [path])
            tasks = spark.read.parquet(path).groupBy(F.spark_partition_id()).count().collect()
            per_task.append(max(r["count"] for r in tasks))
        spark.conf.set(most, "64m")
        reliability.fit_partitions(spark, [path])
        assert spark.conf.get(most) == "64m"
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert per_task[0] == per_task[1] < 20_000


def test_scratch_deletes_what_no_kept_frame_reads(spark):
    outer = reliability.checkpointed(spark.range(5))
    with reliability.Scratch(spark) as scratch:
        a, b, c = (reliability.checkpointed(spark.range(n)) for n in (10, 20, 30))
        joined = a.join(b.where("id > 3"), "id").where(F.col("id").isin([4, 5]))
        assert scratch.holds(a.where("id > 1").select("id")) and not scratch.holds(joined) and not scratch.holds(outer)
        assert not scratch.holds(a.withColumn("x", F.rand()))
        files = [reliability.checkpoints_read([df]) for df in (a, b, c, outer)]
        assert [len(f) for f in files] == [1, 1, 1, 1] and reliability.checkpoints_read([joined]) == files[0] | files[1]
        nested = spark.createDataFrame(joined.rdd, "id bigint")
        assert reliability.checkpoints_read([nested]) is None
        scratch.sweep(nested)  # may read any of them
        assert len(scratch.made) == 3
        scratch.sweep(joined, outer)
        assert scratch.made == files[0] | files[1]
    exists = [os.path.exists(next(iter(f)).removeprefix("file:")) for f in files]
    assert exists == [True, True, False, True] and sorted(r["id"] for r in joined.collect()) == [4, 5]


def _counted(df, seen):
    """The rows of ``df``, each added to an accumulator whenever it is worked out."""

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema)


def test_month_folders_work_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    lake = partitioned.PartitionedLake(spark, str(tmp_path / "lake"), fixtures.spark_schema)
    rows = spark.range(500).select("id", F.concat(F.lit("2001-0"), F.col("id") % 9 + 1).alias("month"), F.col("id").alias("patient_id"))
    lake._write("leads", _counted(rows, seen), "append")
    assert seen.value == 500
    assert spark.read.parquet(lake.folder("leads")).agg(F.count("*"), F.countDistinct("month")).first() == (500, 9)


def test_postings_of_one_file_are_made_by_many_tasks_and_once(spark, tmp_path):
    seen, tasks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    people = spark.range(400).select("id", F.concat(F.lit("Patient "), "id").alias("full_name"), F.lit("98").alias("primary_phone"), F.lit(None).cast("string").alias("email"))
    people.coalesce(1).write.parquet(str(tmp_path / "people"))
    index = search.SearchIndex(spark, str(tmp_path / "index"))

    def count(batches):
        some = 0
        for batch in batches:
            some += len(batch)
            yield batch
        seen.add(some)
        tasks.add(1 if some else 0)

    made = search.postings
    search.postings = lambda rows: made(rows.mapInPandas(count, rows.schema))
    try:
        index.build(spark.read.parquet(str(tmp_path / "people")))
    finally:
        search.postings = made
    assert seen.value == 400 and tasks.value >= 4
    assert {r["id"] for r in index.candidates("t 39").collect()} == {39, *range(390, 400)}
