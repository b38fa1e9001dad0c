"""Leaks at the edges: texts shorter than the item, and similarities just above the threshold."""

import random

import pytest
from llm_helpers import shingle_list

from vekspar.llm import decontaminate


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def jaccard(a, b):
    a, b = set(shingle_list(" ".join(a))), set(shingle_list(" ".join(b)))
    return len(a & b) / len(a | b)


def test_texts_shorter_than_the_item_equal_brute_force():
    rng = random.Random(3)
    items = [fresh(rng, n) for n in (3, 5, 6, 12, 30, 60, 60, 100)]
    texts = [x[s : len(x) - e] for x in items for s in (0, 1, 3, 9) for e in (0, 1, 2, 5)] + [x[:20] + x[21:] for x in items]
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            sims = [round(jaccard(t[s : s + len(x)], x), 9) for s in range(max(len(t) - len(x), 0) + 1)] if t else []
            if sims and max(sims) >= 0.8:
                want[d, i] = (max(sims), sims.index(max(sims)), min(len(x), len(t)))
    got = decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items]).matches([" ".join(t) for t in texts])
    assert {(d, i): (round(sim, 9), p, n) for d, i, sim, p, n in got} == want
    assert any(n < len(items[i]) for (_, i), (_, _, n) in want.items())


@pytest.mark.parametrize(("size", "cut"), [(25, 2), (60, 6), (100, 10)])
def test_copies_just_above_the_similarity_are_found(size, cut):
    rng = random.Random(size)
    items = [fresh(rng, size) for _ in range(400)]
    texts = [[*x[cut:], *fresh(rng, cut + 20)] for x in items]
    assert all(0.8 <= jaccard([*x[cut:], *t[size - cut : size]], x) < 0.84 for x, t in zip(items, texts, strict=True))
    got = decontaminate.Items(list(range(400)), [" ".join(x) for x in items]).matches([" ".join(t) for t in texts])
    assert {(d, i) for d, i, *_ in got} == {(i, i) for i in range(400)}


def test_several_blocks_of_items_equal_one(spark, monkeypatch):
    rng = random.Random(8)
    items = [fresh(rng, 30) for _ in range(40)]
    benchmark = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (3, " ".join(items[3])), (None, " ".join(items[4])), (50, None)], "item_id long, text string")
    rows = [(d, " ".join([*fresh(rng, 20), *(items[d] if d % 3 else fresh(rng, 30))])) for d in range(40)]
    rows += [(7, " ".join(items[8])), (7, "clean words"), (None, " ".join(items[9])), (60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def both():
        leaks = sorted(decontaminate.find_leaks(docs, benchmark).collect(), key=str)
        return leaks, sorted(decontaminate.drop_leaks(docs, benchmark).collect(), key=str)

    one = both()
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 1500)
    assert len(list(decontaminate.item_blocks(benchmark))) > 4
    assert both() == one
    assert len(one[1]) == 14 + 3 and {r.item_id for r in one[0] if r.doc_id == 7} == {7, 8}
