"""Mixing against the exact targets, and with many sources."""

from collections import Counter
from fractions import Fraction

from vekspar.llm import mixing


def test_prefixes_are_within_a_block_of_the_exact_targets():
    counts = {"hot": 10**9} | {f"s{i:03}": 100 for i in range(100)}
    target = mixing.targets(counts, None, 0.5)
    total, had = sum(map(Fraction, target.values())), Counter()
    share = {s: Fraction(w) / total for s, w in target.items()}
    blocks = {s: -(-n // 32) for s, n in counts.items()}
    for t, (s, j, slot, release, due) in zip(range(9000), mixing.plan(mixing.whole_weights(target), blocks), strict=False):
        assert slot == t and j == had[s] and release <= t < due
        had[s] += 1
        if t % 97 == 0:
            assert all(abs(had[x] - w * (t + 1)) < 1 for x, w in share.items())
    assert had["s000"] <= 3 and had["hot"] > 8700


def test_more_sources_than_a_period_once_had(spark):
    got = mixing.mix_sources(spark.range(5200).selectExpr("id doc_id", "string(id % 2600) source"), block=1).collect()
    assert len(got) == 5200 and sorted(r.slot for r in got) == list(range(5200))
    assert all(r.release <= r.slot < r.deadline for r in got)
