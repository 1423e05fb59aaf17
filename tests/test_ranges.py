"""Comparables as arrays against the joins that spread a key, and runs of listed passages."""

import pytest

from lotwise.operators import cells, leaks
from lotwise.plans import market, textual

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["comps_summary", "comps_cascade"])
@pytest.mark.parametrize("whole", [0, 60, 1_200])
def test_keys_with_many_rows_take_the_other_way(spark, monkeypatch, name, whole):
    find = market.REGISTRY.queries[name]
    rows = lambda: sorted(map(str, find(spark, SF).collect()))
    want = rows()
    monkeypatch.setattr(cells, "WHOLE", whole)
    monkeypatch.setattr(cells, "HELD", 500)
    assert len(want) > 50 and rows() == want


def test_runs_of_listed_passages(spark):
    listed = spark.createDataFrame([(1, "a b c"), (1, "b c d"), (2, "b c d"), (3, "x x x")], "item_id long, gram string").collect()
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c d b c d"), (3, "c b a"), (4, None), (5, "x x x x x"), (None, "a b c"), (6, "")], "doc_id long, words string")
    got = {(r.item_id, r.doc_id): r.shared for r in leaks.counted(docs, listed, 3).collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (1, 2): 1, (2, 2): 1, (3, 5): 1, (1, None): 1}
    assert leaks.counted(docs, [], 3).count() == 0 and leaks.counted(docs.limit(0), listed, 3).count() == 0


def test_many_listed_runs_take_a_join(spark, monkeypatch):
    want = sorted(map(str, textual.leak_detect(spark, SF).collect()))
    monkeypatch.setattr(textual, "SENT", 3)
    assert want and sorted(map(str, textual.leak_detect(spark, SF).collect())) == want


@pytest.mark.parametrize("most", [1, 2, 3])
def test_texts_within_edits_are_all_found(spark, most):
    from itertools import product

    from lotwise.functions import strings
    from lotwise.operators import joins

    words = ["".join(p) for n in range(4) for p in product("ab", repeat=n)] + ["blue ring", "bleu ring", "blu rings", "red", None, "blue ring"]
    got = {(r.a, r.b) for r in joins.within_edits(spark.createDataFrame([(w,) for w in words], "t string"), "t", most).collect()}
    own = sorted({w for w in words if w is not None})
    assert {(a, b) for a in own for b in own if a < b and strings.typo_distance(a, b) <= most} <= got
    assert not any(a == "red" or b == "red" for a, b in got if len(a) + len(b) > 9)
