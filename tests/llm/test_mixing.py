from collections import Counter
from fractions import Fraction
from math import pi, sqrt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioweave.llm.mixing import exact, mix, mixed, planned

SCHEMA = "doc_id long, source string, position int, block string"


def furthest(weights, slots, last):
    """How far any source is from its target share after any of `last` slots, as a fraction."""
    parts, had, order = [Fraction(w) for w in weights], [0] * len(weights), {t: i for i, ts in enumerate(slots) for t in ts}
    total, worst = sum(parts), Fraction(0)
    for t in range(last):
        had[order[t]] += 1
        worst = max(worst, *(abs(h * total - p * (t + 1)) for h, p in zip(had, parts, strict=True)))
    return worst / total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(1e-6, 50), min_size=1, max_size=12))
def test_less_than_one_block_from_the_target_at_every_slot(weights):
    slots = planned(exact(weights), [400] * len(weights))
    assert furthest(weights, slots, 400) < 1


@pytest.mark.parametrize("weights", [(1.0, 2.0), (0.7, 0.2, 0.1), (0.9, 0.0999, 0.0001), (sqrt(2), pi, 1 / 3)])
def test_it_stays_so(weights):
    n = 60_000
    slots = planned(exact(weights), [n] * len(weights))
    assert furthest(weights, slots, n) < 1


def test_a_million_slots_by_shares():
    """Each block lies in its window, so after any slot the number of blocks is the share rounded down or up."""
    parts = exact([1.0, 2.0])
    slots = planned(parts, [333_334, 666_667])
    for q, ts in zip(parts, slots, strict=True):
        assert all(j * sum(parts) // q <= t < -(-(j + 1) * sum(parts) // q) for j, t in enumerate(ts))


def test_sources_that_run_out_leave_the_others_in_proportion():
    slots = planned(exact([1.0, 1.0]), [3, 9])
    assert slots[0] == [0, 2, 4] and slots[1] == [1, 3, 5, 6, 8, 10, 12, 14, 16]


def test_whole_table_against_direct_simulation(spark):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None, 7, "z") for i in range(903)]
    weights = {"a": 5.1, "b": 2, None: 0.3}
    out = mix(spark.createDataFrame(rows, SCHEMA), weights, block_rows=4).orderBy("position").collect()
    assert [r.position for r in out] == list(range(903))
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert [r.slot for r in out] == sorted(r.slot for r in out)
    # slot by slot, from the weights themselves
    total, want, t = sum(Fraction(float(w)) for w in weights.values()), [], 0
    left = {s: -(-n // 4) for s, n in Counter(r[1] for r in rows).items()}
    done = dict.fromkeys(left, 0)
    order = [None, "a", "b"]
    while any(done[s] < left[s] for s in left):
        share = {s: Fraction(float(weights[s])) / total for s in left}
        ready = [(-(-(done[s] + 1) // share[s]), order.index(s), s) for s in left if done[s] < left[s] and done[s] // share[s] <= t]
        if ready:
            s = min(ready)[2]
            want.append((t, s, done[s]))
            done[s] += 1
        t += 1
    assert sorted({(r.slot, r.source, r.block) for r in out}) == want
    # blocks grow where there would be too many
    assert {r.block for r in mix(spark.createDataFrame(rows, SCHEMA), weights, block_rows=4, blocks=10).collect()} == set(range(7))


def test_edges(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, 1, "x"), (None, "s", 1, "x"), (1, "s", 1, "x"), (1, "s", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.position for r in mix(docs).collect()) == [0, 1, 2, 3]
    assert sorted(map(str, mixed(docs).collect())) == sorted(map(str, docs.collect()))
    for weights in ({"s": 1.0}, {"s": 1.0, None: 0.0}, {"s": 1.0, None: 1e-300}):
        with pytest.raises(ValueError):
            mix(docs, weights)
