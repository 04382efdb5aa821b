"""The index finds what the scan finds."""

import random

import pytest
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.operators import listing as L
from leadlake.operators.search import FIELDS, SearchIndex, asked_grams, postings, search_leads, search_patients
from leadlake.plans.inspect import plan_text


@pytest.fixture(scope="module")
def people(spark, t):
    odd = [
        (-1, "José Ñandú", "+91 98-1", None), (-2, "JOSE nandu ", "", "jose@x.org"), (-3, None, None, None), (-4, "a", "1", "b"), (-5, "ab", "12", ""),
        (-6, "tab\there", "٣٤٥", "ﬁne"), (-7, "straße 5", "strasse 6", None), (-8, "100% sure_", "a%b", "c_d"), (-9, "ｆｕｌｌ", "x", "y"), (-10, "x" * 3000 + "needle", "0", "n"),
    ]
    base = t.patients.limit(1).drop("id", *FIELDS)
    more = spark.createDataFrame(odd, "id bigint, full_name string, primary_phone string, email string").crossJoin(base)
    return t.patients.where("id < 200").unionByName(more.select(*t.patients.columns)).checkpoint()


@pytest.fixture(scope="module")
def index(spark, people, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    found = SearchIndex(spark, path)
    assert not found.exists()
    found.build(people.where("id % 3 <> 0")).add(people.where("id % 3 = 0")).add(people.where("id = 3"))
    assert found.exists()
    return found


TERMS = [
    "patient 12", "PATIENT", "jose", "José", "josé ñ", "a", "ab", "1", "12", "98-", "example.com", "", " ", "here", "tab\th", "strasse", "straße", "%", "a%b",
    "_", "full", "needle", "xxxxx", "nandu ", "nothing like it", "ne", "34", "fine", "e", "@",
]


@pytest.mark.parametrize("term", TERMS)
def test_index_and_scan_agree(t, people, index, term):
    tables = t.replace(patients=people)
    want = sorted(r["id"] for r in L.list_patients(tables, term).select("id").collect()) if term else sorted(r["id"] for r in people.where(S.search_any(list(FIELDS), term)).collect())
    assert sorted(r["id"] for r in search_patients(tables, index, term).select("id").collect()) == want


def test_leads_by_index(t, people, index):
    tables = t.replace(patients=people)
    for term in ("patient 1", "98000000", "no such"):
        want = sorted(map(str, L.list_leads(tables, search=term, source="organic").collect()))
        assert sorted(map(str, search_leads(tables, index, term, source="organic").collect())) == want


def test_random_stretches(t, people, index):
    draw = random.Random(1)
    texts = [x for r in people.select(*FIELDS).collect() for x in r if x]
    tables = t.replace(patients=people)
    for _ in range(12):
        text = draw.choice(texts)
        a = draw.randrange(len(text))
        term = text[a : a + draw.randint(1, 8)].upper()
        want = {r["id"] for r in people.where(S.search_any(list(FIELDS), term)).collect()}
        assert {r["id"] for r in search_patients(tables, index, term).collect()} == want, term


def test_lookups_read_few_grams(people, index):
    assert asked_grams("José 12") == (["jos", " 12"], []) and asked_grams("é") == ([], []) and asked_grams("ab ") == ([], ["ab"])
    assert index.rarest(["pat", "zzz", "jos"])[0] == "zzz"
    text = plan_text(index.candidates("patient 12"))
    assert "PushedFilters: [In(gram" in text or "PushedFilters: [Or(" in text or "PushedFilters: [IsNotNull(gram)" in text
    assert "Exchange" not in plan_text(postings(people))


def test_candidates_are_looked_up_by_id(spark, t, people, index, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    stored = t.replace(patients=spark.read.parquet(str(tmp_path / "p")))
    text = plan_text(search_patients(stored, index, "needle"))
    assert "PushedFilters: [" in text and "id#" in text and "-10" in text
    assert search_patients(stored, index, "needle").count() == 1
    assert search_patients(stored.replace(patients=stored.patients.where(F.col("id") != -10)), index, "needle").count() == 0
