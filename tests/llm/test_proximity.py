"""Proximity matches against a plain search."""

import hashlib
import random
import re

import pytest

from leadlake.llm import decontaminate


@pytest.mark.parametrize("slack", [1, 3])
def test_proximity_finds_rare_terms_that_moved(spark, slack):
    rng = random.Random(slack)
    word = lambda: f"w{min(int(rng.expovariate(0.12)), 60)}"
    items = [(f"i{k}", [word() for _ in range(rng.choice([1, 4, 6, 9]))]) for k in range(6)] + [(None, ["w1", "w2"]), ("none", [])]
    texts = [[word() for _ in range(rng.randint(0, 40))] for _ in range(25)]
    for _, words in items[:4]:
        torn = list(words)
        torn.insert(len(torn) // 2, "between")
        texts += [["start", *words, "end"], ["start", *torn, "end"], [*words[::-1]]]
    docs = spark.createDataFrame([(" ".join(t),) for t in texts] + [(None,), ("",)] + [(" ".join(texts[0]),)], "text string")
    told = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")

    want = set()
    anchors = decontaminate.rare_places(decontaminate.item_windows(told, "item_id", "text", 5), docs, "text").collect()
    for text in {" ".join(t) for t in texts}:
        own = re.findall(r"[a-z0-9]+", text)
        for a in anchors:
            first, second = a["words"][a["p1"]], a["words"][a["p2"]]
            for at in (k for k, w in enumerate(own) if w == first):
                shift = at - a["p1"]
                if any(0 <= shift + a["p2"] + d < len(own) and own[shift + a["p2"] + d] == second for d in range(-slack, slack + 1)):
                    want.add((hashlib.md5(text.encode()).digest(), a["item"], shift))
    rows = decontaminate.proximity(docs, told, width=5, slack=slack).collect()
    assert len(rows) == len(want) > 0 and {(bytes(r["digest"]), r["item"], r["shift"]) for r in rows} == want
    assert decontaminate.proximity(docs.limit(0), told, width=5, slack=slack).isEmpty()
