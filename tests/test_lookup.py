import random

import pytest

from folioweave.functions.fuzzy import token_set_ratio
from folioweave.operators import symbols as sy
from folioweave.operators.lookup import token_set_matches


@pytest.mark.parametrize("least", [90, 75, 60])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(least)
    words = ["the", "act", "of", "marks", "mark", "trade", "trades", "goods", "sale", "a", "b", "cd", "evidence", "evidences", "limitation"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(90)} | {"a b", "a", "b", "", "x" * 40, "x" * 38, "a b a c d e f g"}
    for n in sorted(names)[:40]:
        i = rng.randrange(len(n) + 1)
        names.add(n[:i] + rng.choice(["", "x", "yz", " "]) + n[i + 1 :])
    a = sorted(names)
    b = a[::2] + ["another name", None]
    got = {(r.a, r.b): round(r.score, 9) for r in token_set_matches(*(spark.createDataFrame([(n,) for n in s], "name string") for s in (a, b)), least).collect()}
    want = {(x, y): round(s, 9) for x in a for y in b if y is not None and x.split() and y.split() and (s := token_set_ratio(x, y)) >= least}
    assert {p: s for p, s in got.items() if p[0].split() and p[1].split()} == want


def test_years_ties_and_gaps(spark):
    index = [("i1", "Trade Marks Act, 1999", 1999), ("i2", "Trade Marks Act, 1958", 1958), ("i3", "The Trade Marks Act, 1940", 1940), (None, "Trade Marks Act", None), ("i5", None, 1999), ("i6", "Limitation Act, 1963", 1963), ("i7", "Limitation Act, 1963", 1963)]
    acts = ["Trade Marks Act, 1958", "Trade Mark Act, 1999", "trade marks act", "Limitation Act", "Nothing of the kind", None]
    rows = sy.looked_up_acts(spark.createDataFrame([(a,) for a in acts], "act string"), spark.createDataFrame(index, "id string, short_title string, act_year int")).collect()
    assert {r.act: r.id for r in rows} == {"Trade Marks Act, 1958": "i2", "Trade Mark Act, 1999": "i1", "trade marks act": "i1", "Limitation Act": "i6"}
