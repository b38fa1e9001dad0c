"""Byte-exact dedup, Jaccard join, repeated passages and vectors against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from llm_helpers import prose, shingle_list

from vekspar.llm import common, forest, jaccard, packed, passages, suffixes


def brute_bytes(rows, n=50):
    owner, out = {}, {}
    for d, t in sorted(rows):
        x = (t or "").encode()
        hit = np.zeros(len(x), bool)
        for i in range(len(x) - n + 1):
            if owner.setdefault(x[i : i + n], d) < d:
                hit[i : i + n] = True
        edge = np.diff(np.r_[0, hit.astype(int), 0])
        out[d] = (len(x), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, h in zip(x, hit, strict=True) if not h)).hexdigest())
    return out


def test_suffixes_equal_brute_force(spark, corpus, documents, monkeypatch):
    rows = [(d, t) for d, t in corpus]
    got = suffixes.remove_repeats(documents)
    assert got.columns == [*documents.columns, "removed", "kept"] and got.count() == documents.count()
    want = brute_bytes(rows)
    seen = set()
    for r in got.where("doc_id is not null").collect():
        assert (len((r.text or "").encode()), sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], r.doc_id
        assert r._marks == "m" and r._id == r.doc_id
        seen.add(r.doc_id)
    assert seen == set(want)


def test_entries_stay_small_where_each_has_a_document_of_its_own():
    """With many shards a row's entries are nearly all of unlike documents; their ids and checksums must not outweigh them."""
    rng = np.random.default_rng(2)
    doc = rng.permutation(20_000)[:3000]
    e = {"doc": doc, "tx": rng.integers(0, 2**32, 20_000)[doc], "p": rng.integers(0, 9000, 3000), "n": rng.integers(1, 32, 3000)}
    e |= {k: rng.integers(0, 2**63, 3000).astype(np.uint64) for k in "ab"}
    data = packed.pack(suffixes.RUN, e)
    got, order = packed.unpack(suffixes.RUN, [data]), np.argsort(doc)
    assert len(pa.compress(data, codec="lz4", asbytes=True)) <= 28 * 3000
    got_order = np.argsort(got["doc"])
    assert all((got[k][got_order] == e[k][order]).all() for k in e)
    again = e | {"doc": e["doc"] // 7}  # ids shared by texts
    got = packed.unpack(suffixes.RUN, [packed.pack(suffixes.RUN, again, np.arange(100)), packed.pack(suffixes.RUN, again, np.arange(100, 3000))])
    rows = [sorted(zip(*(x[k].tolist() for k in ("doc", "tx", "p", "n", "a", "b")), strict=True)) for x in (again, got)]
    assert rows[0] == rows[1]


def test_suffixes_over_many_small_tasks_and_shards(spark, monkeypatch):
    rng = random.Random(9)
    bits = [prose(rng, rng.randrange(3, 14)) for _ in range(30)]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 8)))) for i in range(150)] + [(200 + i, "a" * (40 + i)) for i in range(30)]
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 3000)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    want = brute_bytes(rows)
    assert {r.doc_id: (len(r.text.encode()), sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got} == want


def test_suffixes_of_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(11)
    bits = [prose(rng, rng.randrange(3, 40)) for _ in range(40)]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(5, 30)))) for i in range(40)]
    rows += [(50, "a" * 900), (51, "a" * 1900), (52, rows[3][1]), (53, rows[3][1]), (54, "b" * 301), (55, "b" * 300)]
    whole = suffixes.runs([rows[3][1].encode()])
    parts = list(suffixes.long_runs(rows[3][1].encode(), suffixes.LENGTH, 300))
    assert len(parts) > 1 and all((np.concatenate([x[k] for x in parts]) == whole[k]).all() for k in ("a", "b", "p", "n"))
    monkeypatch.setattr(suffixes, "PIECE", 300)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 3000)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (len(r.text.encode()), sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got} == brute_bytes(rows)


def test_index_family_levels_are_geometric():
    family, rng, all_ = suffixes.IndexFamily(), np.random.default_rng(0), {}
    for batch in range(20):
        a = rng.integers(0, 400, 60).astype(np.uint64)
        found = family.add(a, a, np.full(60, batch))
        for x, f in zip(a.tolist(), found, strict=True):
            assert f == (all_.get(x, batch) < batch)
        for x in a.tolist():
            all_.setdefault(x, batch)
    sizes = [len(x[0]) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def brute_links(rows):
    sets = {d: frozenset(shingle_list(t)) for d, t in rows}
    links = {d: set() for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    return links


def classes_of(links):
    root = {}
    for d in sorted(links):
        if d not in root:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = d
                    todo += links[x]
    return root


def test_jaccard_equals_brute_force(spark, corpus):
    rng = random.Random(2)
    rows = list(corpus)
    for i in range(100, 160):  # chains of near copies
        w = rows[-1][1].split(" ") if i % 10 else prose(rng, 120).split(" ")
        w[rng.randrange(len(w))] = f"yy{i}"
        rows.append((i, " ".join(w)))
    links = brute_links(rows)
    root = classes_of(links)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, count int, root int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(docs).collect()}
    assert got == {d: (root[d], len(links[d])) for d in links}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_jaccard_in_small_blocks(spark, monkeypatch):
    """Large groups go by bands, in several blocks; buckets are cut as well."""
    rng = random.Random(12)
    rows, at = [], 0
    for n in (80, 25):  # a chain of near copies, and a dense group
        base = prose(rng, 140).split(" ")
        for _ in range(n):
            w = base if n == 80 else list(base)
            w[rng.randrange(len(w))] = f"zz{at}"
            rows.append((at, " ".join(w)))
            at += 1
    rows += [(at + i, prose(rng, 90)) for i in range(20)]
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 12_000)
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 8)
    monkeypatch.setattr(jaccard, "TILE", 5)
    monkeypatch.setattr(jaccard, "COLUMNS", 37)
    links = brute_links(rows)
    root = classes_of(links)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (root[d], len(links[d])) for d in links}


def test_components_with_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    edges = [(7, i) for i in range(10, 3000)] + [(5000 + i, 5001 + i) for i in range(40)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {7: 7, **dict.fromkeys(range(10, 3000), 7), **dict.fromkeys(range(5000, 5041), 5000)}


def test_jaccard_edges(spark, documents, nothing):
    assert jaccard.similar_documents(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0
    got = jaccard.similar_documents(documents).collect()
    assert len(got) == documents.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[5]) == 2 and by[5][0] == by[5][1] and by[5][0].class_id == 5
    assert by[21][0].n_links == 0 and by[21][0].class_id == 21 and by[23][0].n_links == 1
    assert jaccard.one_of_each(documents).where("doc_id is null").count() == 1


def test_pruning_tolerance():
    least = jaccard.least_matches(0.8)
    for n, m in least.items():  # what is dropped would hold at 0.8 with a small chance only
        assert sum(math.comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(m)) < 0.01


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(5, 5)]
    links = {x: set() for e in edges for x in e}
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    want = {k: v for k, v in classes_of(links).items() if links[k] - {k}}
    assert {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages(spark, corpus, documents, nothing):
    got = passages.repeated_passages(documents).collect()
    texts = dict(corpus)
    for r in got:
        assert r.match_doc_id < r.doc_id and r.word_end - r.word_start >= passages.PASSAGE and r.similarity >= 0.8
    pairs = {(r.doc_id, r.match_doc_id) for r in got}
    assert {9, 22} <= {d for d, m in pairs if m == 3 or m == 9}
    assert {12, 30, 31, 13, 14, 15} <= {d for d, _ in pairs}
    shared = {d for d, t in texts.items() if d not in (3, 5, 9, 12, 13, 14, 15, 16, 22, 30, 31)}
    plain = {d: set(shingle_list(t)) for d, t in texts.items()}
    for d, m in pairs:
        assert len(plain[d] & plain[m]) >= 30, (d, m)
    assert not {d for d, _ in pairs} & shared - {27}
    assert passages.repeated_passages(nothing).count() == 0


def test_compact_windows_hold_all_passages():
    rng = np.random.default_rng(3)
    s, width = rng.integers(0, 2**63, 300, dtype=np.uint64), passages.PASSAGE - passages.WIDTH + 1
    w = passages.windows(s, np.array([0, 300]))
    from vekspar.llm.words import mix

    for f in range(passages.FUNCTIONS):
        h = mix(s ^ passages._SALT[f])
        own = (w["key"] & np.uint64(7)) == f
        c, left, right = (w[k][own].astype(int) for k in ("c", "l", "r"))
        for a in range(0, 300 - width, 7):
            b = a + width + (a * 13) % (300 - width - a)
            least = a + int(h[a : b].argmin())
            assert ((c == least) & (c - left <= a) & (c + right >= b - 1)).sum() == 1


def brute_vectors(rows):
    ok = {}
    for i, v, lab in rows:
        if lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, float)
            ok[i] = (lab, x / np.abs(x).max())
    links = {r[0]: set() for r in rows}
    for a, (la, x) in ok.items():
        for b, (lb, y) in ok.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a].add(b)
    return links


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, base = [], rng.standard_normal((120, 16))
    for i in range(1200):
        v = base[rng.integers(120)] + rng.standard_normal(16) * rng.choice([0.0, 0.08, 0.2, 0.6])
        rows.append((i, (v * rng.choice([1.0, 3.0])).tolist(), int(i % 3) if i % 50 else None))
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] + [1.0] * 15, 1), (2004, [None] + [1.0] * 15, 1), (2005, [1e300] * 16, 1), (2006, [1e-300] * 16, 1), (2007, [1.0] * 4, 1)]
    links = brute_vectors(rows)
    root = classes_of(links)
    for k, v in (("LEAF", 20), ("SPLIT", 60), ("DEPTH", 2), ("SAMPLE", 100), ("BLOCK", 50), ("TILE", 16)):  # several rounds
        monkeypatch.setattr(forest, k, v)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, key int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_vectors(df).collect()}
    want = {i: (len(links[i]), root[i], root[i] == i) for i in links}
    assert len(got) == len(want)
    found, all_ = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert found <= all_ and all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * all_
    assert forest.near_vectors(df.limit(0)).count() == 0


def test_vectors_at_production_parameters(spark):
    """Recall of pairs just above the threshold in a label of many leaves; ids that repeat."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((6000, 32))
    y -= (y * x[:6000]).sum(1, keepdims=True) * x[:6000]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.981, 0.999, (6000, 1))
    y = c * x[:6000] + np.sqrt(1 - c * c) * y
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.r_[x, y])] + [(3, x[7].tolist(), 1)]
    got = {}
    for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect():
        got.setdefault(r.vec_id, []).append(r)
    met = sum(got[12_000 + i][0].n_links >= 1 and got[12_000 + i][0].component_id == (3 if i == 7 else i) for i in range(6000))
    assert met >= 0.995 * 6000
    assert len(got[3]) == 2 and {r.component_id for r in got[3] + got[7]} == {3} and sum(len(v) for v in got.values()) == len(rows)


def test_vectors_in_parts_and_blocks(spark, monkeypatch):
    """Links as by brute force where a label is cut into parts and a large group of near copies into blocks."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    x[1500:1900] = x[:400] + 0.1 * rng.standard_normal((400, 64))
    x[2500:] = x[2500] + 0.08 * rng.standard_normal((500, 64))
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= forest.COSINE
    np.fill_diagonal(near, False)
    for k, v in (("SPLIT", 300), ("BLOCK", 200), ("LEAF", 32)):
        monkeypatch.setattr(forest, k, v)
    got = {r.vec_id: r for r in forest.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    want = near.sum(axis=1)
    n = np.array([got[i].n_links for i in range(3000)])
    assert (n <= want).all() and n.sum() >= 0.999 * want.sum() and want[2500:].min() >= 400
    assert all(got[i].component_id == 2500 for i in range(2500, 3000))


def test_vectors_travel_to_few_parts(spark, monkeypatch):
    """A vector is sent for each part, not for each leaf of each tree."""
    x, sent, grouped = np.random.default_rng(9).standard_normal((4000, 64)), [], forest.by_group
    monkeypatch.setattr(forest, "SPLIT", 1000)
    monkeypatch.setattr(forest, "by_group", lambda df, keys, *a, **b: (sent.append(df.count()) if "bi" in keys else None, grouped(df, keys, *a, **b))[1])
    assert forest.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).count() == 4000
    assert 4000 < sum(sent) <= 4 * 4000
