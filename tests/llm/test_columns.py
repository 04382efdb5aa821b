"""Extra columns named like helpers and results keep their values; columns named like a result are replaced by it."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadlake.llm import bpe_codec, decontaminate, langid, pii, quality, secret_scan, sharding, simhash, token_counts
from tests.conftest import SF_DIR

NAMES = (
    "g", "x", "_text_hash", "center", "factor", "_large", "n_words", "distance", "kept", "n_hit", "item_ids", "_digest", "_key", "n_items",
    "contaminated", "_k", "_e", "_d", "_n", "best", "_rows", "root", "fp", "_least", "component_id", "_text", "digest", "_digit", "base", "_marked",
    "candidates", "_new", "shard", "slot", "size", "text_crc32", "_before", "_inside", "virtual_slot", "_coded", "_p", "told", "row", "start", "end",
    "item", "upto", "key", "lang_pred", "score", "n_tokens", "n_bytes", "over_limit", "_input_0_x", "base_failed", "secrets",
)
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def wide(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 80")
    return docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES}).checkpoint()


def keeps_values(df, names):
    rows = df.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n not in ("doc_id", "text"))


@pytest.mark.parametrize("number", range(4))
def test_stages(spark, wide, number):
    out = corpus_pipeline.STAGES[number][1](spark, wide, SF_DIR)
    assert out.columns == wide.columns
    keeps_values(out, NAMES)


def test_last_stage(spark, wide):
    assert corpus_pipeline.STAGES[4][1](spark, wide, SF_DIR).count() == wide.count()


def test_operators(spark, wide):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").withColumns({n: F.lit("z") for n in ("item", "words", "first", "long", "told", "term")})
    cases = {
        "contamination": (decontaminate.contamination(wide, items), ("n_words", "n_hit", "n_items", "item_ids", "contaminated")),
        "one_per_group": (simhash.one_per_group(wide), ()),
        "kept_documents": (quality.kept_documents(wide), ()),
        "shard_documents": (sharding.shard_documents(wide, 3), ("virtual_slot", "size", "text_crc32", "shard", "slot")),
        "identify": (langid.identify(wide, None), ("lang_pred", "score")),
        "identify, learnt": (langid.identify(wide, langid.learn(wide)), ("lang_pred", "score")),
        "round_trip": (bpe_codec.round_trip(wide, BPE), bpe_codec.ROUND_TRIP),
        "token_counts": (token_counts.token_counts(wide, BPE), ("n_bytes", "n_tokens", "over_limit")),
        "secret_spans": (secret_scan.secret_spans(wide), ("secrets",)),
        "mask_secrets": (secret_scan.mask_secrets(wide), ()),
    }
    for name, (df, results) in cases.items():
        assert sorted(df.columns) == sorted({*wide.columns, *results}), name
        keeps_values(df, [n for n in NAMES if n not in results])
    keep = ["doc_id", "_text", "digest", "base", "_digit", "start", "candidates"]
    found = pii.personal_data(wide, keep)
    assert found.columns == [*keep, "pii"]
    keeps_values(found, keep)
    same = pii.personal_data(wide.select("doc_id", "text"), ["doc_id"])
    assert sorted(map(str, same.collect())) == sorted(map(str, found.select("doc_id", "pii").collect()))
