"""Mixing, decontamination, quality and the pipeline."""

import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from llm_helpers import prose, shingle_list

from vekspar.llm import decontaminate, mixing, quality
from vekspar.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 500, "b": 333, "c": 167, "d": 1}, {str(i): i + 1 for i in range(20)}])
def test_every_prefix_is_within_a_block(weights):
    slots, total, had = mixing.period(weights), sum(weights.values()), Counter()
    assert len(slots) == total
    for t, (s, j, release, due) in enumerate(slots):
        assert release <= t < due and j == had[s]
        assert release == j * total // weights[s] and due == math.ceil((j + 1) * total / weights[s])
        had[s] += 1
        assert all(abs(had[x] - w * (t + 1) / total) < 1 for x, w in weights.items())
    assert had == weights


def test_mixing_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SALT_ROWS", 50)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}" if i % 5 else None, i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _rank long")
    out = mixing.mix_sources(docs, block=4)
    got = out.collect()
    assert out.columns == [*docs.columns, "block", "slot", "release", "deadline", "position"]
    assert sorted((r.doc_id, r._rank) for r in got) == [(i, i) for i in range(2000)]
    assert len({r.position for r in got}) == 2000
    of = {}
    for r in got:
        assert r.release <= r.slot < r.deadline and r.position // 4 == r.slot
        assert of.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(of) == list(range(len(of)))
    counts = Counter(r[1] for r in rows)
    w = mixing.whole_weights({str(s): n**0.5 for s, n in counts.items()})
    total, had = sum(w.values()), Counter()
    dry = min(-(-counts[s] // 4) / w[str(s)] for s in counts) * total  # all sources have blocks until then
    for t in range(int(dry) - total):
        had[str(of[t][0])] += 1
        assert all(abs(had[s] - x * (t + 1) / total) < 1 for s, x in w.items())


def test_mixing_edges(spark, documents, nothing):
    assert mixing.mix_sources(nothing).count() == 0
    got = mixing.mix_sources(documents, {"web": 3.0})
    assert got.count() == documents.count() and got.columns[: len(documents.columns)] == documents.columns
    assert mixing.mix_sources(spark.range(2100).selectExpr("id doc_id", "string(id) source")).count() == 2100  # no cap on sources
    with pytest.raises(ValueError):
        mixing.mix_sources(documents, {"web": 0.0})


def test_mixing_keeps_columns_and_splits_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SALT_ROWS", 20)
    rows = [(None, "hot", 7, 1) for _ in range(300)] + [(i, "cold", i, 2) for i in range(50)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, block int, Slot int"), block=4)
    assert out.columns == ["doc_id", "source", "block", "Slot", "_block", "_slot", "release", "deadline", "position"]
    got = out.collect()
    assert sorted(map(repr, [tuple(r)[:4] for r in got])) == sorted(map(repr, rows)) and len({r.position for r in got}) == 350


def test_pipeline_keeps_every_column(spark, tmp_path):
    names = ["score", "predicted", "block", "slot", "release", "deadline", "position", "row", "_marks", "id", "set_key", "class_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.selectExpr("*", *(f"concat('{n}', doc_id) as `{n}`" for n in names))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[: len(docs.columns)] == docs.columns and len(got.columns) == len(docs.columns) + 5
    rows = got.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    plain = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert {r.doc_id for r in rows} == plain


def weighted(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_leaks_equal_brute_force(spark):
    import re

    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate((1, 3, 5, 12, 30, 30, 60, 90))] + [(20, None), (21, ""), (22, "?!")]
    rows = []
    for i in range(60):
        own = rng.choice(items[2:8])[1].split(" ")
        for _ in range(i % 4):
            own[rng.randrange(len(own)) if i % 2 else -1] = f"zz{i}"
        rows.append((i, " ".join([prose(rng, rng.randrange(60)), *own, prose(rng, rng.randrange(40))])))
    rows += [(100, None), (101, ""), (102, prose(rng, 3000)), (None, items[6][1]), (103, items[1][1])]
    docs, bench = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    want = {}
    for d, t in rows:
        w = words(t)
        for i, x in items:
            n = len(words(x))
            grams = shingle_list(x)
            sims = [weighted(shingle_list(" ".join(w[s : s + n])), grams) for s in range(len(w) - n + 1)] if n else []
            if sims and max(sims) >= 0.8:
                want[d, i] = (round(max(sims), 9), sims.index(max(sims)), n)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.word_start, r.n_words) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want
    bad = {d for d, _ in want}
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in bad)


def test_leaks_of_nothing(spark, documents, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(documents, none).count() == 0 and decontaminate.drop_leaks(documents, none).count() == documents.count()
    assert decontaminate.find_leaks(nothing, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_all_prints_within_the_radius_are_found():
    rng = np.random.default_rng(2)
    items = decontaminate.Items([0], ["one two three four five six"])
    flips = [rng.choice(64, k, replace=False) for k in range(decontaminate.RADIUS + 1) for _ in range(200)]
    prints = np.array([items.prints[0] ^ np.bitwise_or.reduce(np.r_[np.uint64(0), np.uint64(1) << f.astype(np.uint64)]) for f in flips], np.uint64)
    win, _ = items.near(prints, 6)
    assert sorted(win.tolist()) == list(range(len(prints)))


def test_quality_ranks_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op10_quality_ranking(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert ((good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()) > 0.8
    assert (got.predicted == got.quality).mean() > 0.8


def test_quality_edges(spark, documents, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (4, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(documents, labels)
    got = out.collect()
    assert out.columns == [*documents.columns, "score", "predicted"] and len(got) == documents.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in quality.quality_scores(documents, labels.limit(0)).collect())
    assert quality.quality_scores(nothing, labels).count() == 0


def test_pair_learning():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 5))
    good = (x @ [2, -1, 0, 0, 0.5] + 0.3 * rng.standard_normal(800) > 0).astype(int)
    m = quality.fit(x, good)
    assert ((quality.score(m, x) >= quality.CUT) == good).mean() > 0.92 and m["w"][0] > 0 > m["w"][1]


def test_stages_take_effect(spark):
    docs, before, n = spark.read.parquet(f"{SF}/documents.parquet"), None, None
    from vekspar.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns
        a, b = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        assert set(b) <= set(a)
        if name == "near_duplicates":
            sets = {d: frozenset(shingle_list(t)) for d, t in b.items()}
            ids = [d for d in sorted(sets) if sets[d]]
            assert not [(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :] if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
        if name == "secrets":
            from vekspar.llm.secrets import scan

            assert set(a) == set(b) and sum(bool(scan(t)) for t in b.values()) <= sum(bool(scan(t)) for t in a.values())
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0
