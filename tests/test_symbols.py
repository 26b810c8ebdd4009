import random

import pytest

from folioweave.functions.fuzzy import token_sort_ratio
from folioweave.operators import symbols as sy


def unblocked(names, least):
    heads, out = {}, {}
    for kind, text, _ in sorted(names, key=lambda n: n[2]):
        pool = heads.setdefault(kind, [])
        best = max(((token_sort_ratio(text, h), -i, h) for i, h in enumerate(pool)), default=(0.0, 0, ""))
        if best[0] < least:
            pool.append(text)
        out.setdefault((kind, text), f"{kind}:{best[2] if best[0] >= least else text}")
    return out


@pytest.mark.parametrize("least", [88, 70])
def test_canonical_entities_against_the_unblocked_fold(spark, least):
    rng = random.Random(3)
    words = ["cold", "old", "gold", "plate", "ring", "rod", "widget", "widgets", "ab", "abc", "abcd", "bc"]
    texts = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(120)}
    for t in sorted(texts)[:60]:
        i = rng.randrange(len(t))
        texts.add(" ".join(w for w in (t[:i] + rng.choice(["", "x", "yz"]) + t[i + 1 :]).split() if len(w) > 1) or "none")
    shuffled = sorted(texts)
    rng.shuffle(shuffled)
    names = [("PART" if i % 4 else "ORG", t, i) for i, t in enumerate(shuffled)]
    rows = sy.canonical_entities(spark.createDataFrame(names, "kind string, text string, ord int"), least).collect()
    assert {(r.kind, r.text): r.entity_id for r in rows} == unblocked(names, least) and len(rows) == len(names)


def test_names_with_different_first_letters(spark):
    names = [("PART", "cold plate", 1), ("PART", "old plate", 2), ("PART", "cold rod", 3), ("PART", "old rod", 4), ("ORG", "old plate", 5)]
    rows = sy.canonical_entities(spark.createDataFrame(names, "kind string, text string, ord int")).collect()
    assert {(r.kind, r.text): r.entity_id for r in rows} == {("PART", "cold plate"): "PART:cold plate", ("PART", "old plate"): "PART:cold plate", ("PART", "cold rod"): "PART:cold rod", ("PART", "old rod"): "PART:cold rod", ("ORG", "old plate"): "ORG:old plate"}
