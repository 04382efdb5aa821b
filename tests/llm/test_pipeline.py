"""The pipeline against a version put together from single documents' results."""

import corpus_pipeline
from leadlake.llm import decontaminate, quality, secret_scan, simhash
from tests.conftest import SF_DIR


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stats = quality.with_statistics(docs)
    good = {r["doc_id"] for r in quality.judged(stats, quality.estimates(stats)).where("kept").collect()}
    left = docs.where(docs["doc_id"].isin(list(good)))
    alone = {r["doc_id"] for r in simhash.near_duplicates(left).where("doc_id = component_id").collect()}
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    clean = {r["doc_id"]: secret_scan.mask(r["text"]) for r in decontaminate.contamination(docs, items).where("not contaminated").collect() if r["doc_id"] in alone}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in got} == set(clean) and len(got) == len(clean)
    from hashlib import sha256

    assert all(r["decoded_sha256"] == sha256(clean[r["doc_id"]].encode()).hexdigest() for r in got)


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "plain words of a text " * 9, "en", None, 9, 3), (2, "plain words of a text " * 9, "en", None, 9, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SF_DIR).columns == df.columns
            stage(spark, df, SF_DIR).collect()
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF_DIR).count() == 2
