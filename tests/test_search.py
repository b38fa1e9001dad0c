"""Search kernels against each other and NumPy; approximate indexes; vector files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vekspar.errors import EngineError
from vekspar.functions import distance
from vekspar.operators import ann, search
from vekspar.sources.vectors import read_vecs

RNG = np.random.default_rng(8)
X = RNG.standard_normal((600, 16)).astype(np.float32)
Q = X[:6] + 0.1


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, i, i % 5, x.tolist()) for i, x in enumerate(X)] + [(9000, 9000, 0, None), (9001, 9001, 0, [1.0]), (9002, 9002, 1, [None] * 16), (9003, 9003, 1, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "_id long, _docid long, g int, v array<float>").repartition(5).cache()


@pytest.mark.parametrize("metric", ["InnerProduct", "L2", "Cosine"])
def test_kernel_equals_columns(spark, data, metric):
    got = search.top_k(data, "v", Q, 7, metric).collect()
    q = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(Q)], "qid long, q array<double>")
    want = search.top_k_columns(data.where("_id < 9000"), "v", q, 7, metric).collect()
    key = lambda r: (r.qid, r._rank, r._id)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_filter_before_equals_after(data):
    before = search.top_k(data, "v", Q, 5, where=F.col("g") == 2)
    after = search.ranked(search.top_k(data, "v", Q, 1000).join(data.where("g = 2").select("_id"), "_id").drop("_rank"), 5, True)
    assert before.exceptAll(after.select(before.columns)).count() == 0 and before.count() == 30


def test_ties_go_by_id(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "_id long, v array<double>").repartition(7)
    assert [r._id for r in search.top_k(same, "v", [[1.0, 1.0]], 5).orderBy("_rank").collect()] == [0, 1, 2, 3, 4]


def test_empty_and_bad(spark, data):
    empty = spark.createDataFrame([], "_id long, v array<float>")
    assert search.top_k(empty, "v", Q, 5).count() == 0
    for bad in ([], [[]], [[float("nan")] * 16]):
        with pytest.raises(EngineError):
            search.top_k(data, "v", bad, 5)
    with pytest.raises(EngineError):
        search.weighted_ranker(["a", "b"], {"type": "WeightedRanker", "params": [1]})
    with pytest.raises(Exception, match="cannot be normalized"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(distance.normalized(F.col("v"))).collect()


def test_blocks_of_queries(data, monkeypatch):
    want = search.top_k(data, "v", Q, 3)
    monkeypatch.setattr(search, "QUERY_BYTES", 2 * 16 * 8)
    assert search.top_k(data, "v", Q, 3).exceptAll(want).count() == 0


@pytest.mark.parametrize(("kind", "params"), [("IVFFLAT", {}), ("IVFPQ", {"nsubvector": 8, "recall_num": 100}), ("IVFRABITQ", {"nb_bits": 4, "recall_num": 50}), ("IVFRABITQ", {"nb_bits": 1, "recall_num": 150}), ("HNSW", {})])
@pytest.mark.parametrize("metric", ["L2", "InnerProduct"])
def test_recall(data, kind, params, metric):
    model = ann.make(kind, "v", 16, metric, ncentroids=12, **params).fit(data)
    table = model.assign(data)
    truth = search.top_k(data, "v", Q, 100, metric)
    got = {r.k: r.recall for r in search.recall(model.search(table, Q.tolist(), 100, nprobe=12), truth).collect()}
    assert got[1] >= 0.5 and got[10] >= 0.8 and got[100] >= 0.9


def test_binary_ivf(spark):
    bits = np.packbits(X > 0, axis=1)
    df = spark.createDataFrame([(i, i, bytearray(b.tobytes())) for i, b in enumerate(bits)], "_id long, _docid long, v binary")
    model = ann.make("BINARYIVF", "v", 2, ncentroids=5).fit(df)
    got = model.search(model.assign(df), bits[:3].tolist(), 4, nprobe=5).orderBy("qid", "_rank").collect()
    for i in range(3):
        d = np.bitwise_count(bits ^ bits[i]).sum(1)
        assert [r._id for r in got if r.qid == i] == np.lexsort((np.arange(600), d))[:4].tolist()


def test_too_few_to_train(data):
    with pytest.raises(EngineError):
        ann.make("IVFFLAT", "v", 16, ncentroids=5000).fit(data)


def test_vector_files(spark, tmp_path):
    x = RNG.standard_normal((20, 4)).astype("<f4")
    (tmp_path / "a.fvecs").write_bytes(b"".join(np.int32(4).tobytes() + r.tobytes() for r in x))
    got = read_vecs(spark, str(tmp_path / "a.fvecs"), "fvecs").orderBy("row").collect()
    assert np.array_equal(np.array([r.vector for r in got], np.float32), x)


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e12])
@pytest.mark.parametrize("metric", ["L2", "InnerProduct", "Cosine"])
def test_scores_at_any_scale(spark, scale, metric):
    x = (np.arange(1, 41)[:, None] * [1.0, 0.5] + [0, 3.0]) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id long, v array<double>")
    q = x[[33]] * [1, 1.0001]
    got = search.top_k(df, "v", q, 5, metric).orderBy("_rank").collect()
    s = {"L2": ((x - q) ** 2).sum(1), "InnerProduct": (x * q).sum(1), "Cosine": (x * q).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(q)}[metric]
    want = np.argsort(s if metric == "L2" else -s, kind="stable")[:5]
    assert [r._id for r in got] == want.tolist() and np.allclose([r._score for r in got], s[want], rtol=1e-9)


def test_small_tiles_and_query_tables(spark, data, monkeypatch):
    want = search.top_k(data, "v", Q, 7, "L2").collect()
    monkeypatch.setattr(search, "CELLS", 30)
    assert sorted(search.top_k(data, "v", Q, 7, "L2").collect()) == sorted(want)
    monkeypatch.setattr(search, "QUERY_BYTES", 2 * 16 * 8)
    table = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(Q.astype(float))], "qid long, q array<double>")
    for got in (search.top_k_rows(data, "v", table, 7, "L2"), search.top_k_columns(data, "v", table, 7, "L2")):
        assert [r[:2] for r in sorted(map(tuple, got.select("qid", "_id").collect()))] == sorted((r.qid, r._id) for r in want)


def test_registered_and_described_indexes(data):
    from vekspar.operators.search import top_k

    for text, kind in (("Flat", ann.Flat), ("IVF7,Flat", ann.IvfFlat), ("IVF7,PQ4", ann.IvfPq), ("OPQ4,IVF7,PQ4", ann.IvfPq), ("IVF7,RaBitQ9", ann.IvfRabitq), ("HNSW16", ann.GraphIndex)):
        model = ann.from_description(text, "v", 16, "L2", recall_num=60).fit(data)
        assert type(model) is kind
        again = ann.VectorIndex.load(model.dump())
        got = again.search(again.assign(data), Q.tolist(), 3, nprobe=7)
        truth = top_k(data, "v", Q, 3, "L2")
        assert search.recall(got, truth, (1,)).first().recall >= 0.8
    with pytest.raises(EngineError):
        ann.from_description("PCA4,IVF7", "v", 16)

    class Mine(ann.Flat):
        pass

    ann.register("MINE", Mine)
    try:
        assert type(ann.make("MINE", "v", 16)) is Mine
    finally:
        del ann.KINDS["MINE"]


@pytest.mark.parametrize(("kind", "params"), [("IVFPQ", {"nsubvector": 4}), ("IVFPQ", {"nsubvector": 4, "opq": True}), ("IVFRABITQ", {"nb_bits": 2}), ("IVFRABITQ", {"nb_bits": 9})])
@pytest.mark.parametrize("metric", ["L2", "InnerProduct", "Cosine"])
def test_whole_reranking_is_exact(spark, kind, params, metric):
    """More near copies than recall_num have equal codes."""
    rng = np.random.default_rng(5)
    x = np.vstack([X, X[0] + 1e-4 * rng.standard_normal((300, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "_id long, _docid long, v array<float>").repartition(5)
    model = ann.make(kind, "v", 16, metric, ncentroids=6, **params).fit(df)
    got = model.search(model.assign(df), Q.tolist(), 9, nprobe=6, recall_num=20, whole=True)
    key = lambda d: sorted((r.qid, r._rank, r._id, r._score) for r in d.collect())
    assert key(got) == key(search.top_k(df, "v", Q, 9, metric))


def test_scores_are_not_rounded_twice(spark):
    """To nine decimals, 1.11561700050 is what 1.115617000496 would become by way of twelve digits."""
    df = spark.createDataFrame([(1, [1.115617000496])], "_id long, v array<double>")
    assert search.top_k(df, "v", [[1.0]], 1).select(F.round("_score", 9)).first()[0] == 1.115617


def test_query_tables_need_no_interpreted_arithmetic(spark, data):
    """Queries of several lengths, null or not finite, against plain Columns; the pairs are scored in tasks, by matrix products."""
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(Q)] + [(10, [2.0]), (11, None), (12, [float("nan")] * 16), (13, [None] * 16), (14, [])]
    q = spark.createDataFrame(rows, "qid long, q array<double>")
    got = search.top_k_columns(data, "v", q, 4, "L2")
    met = data.join(q.where("qid < 11"), F.size("v") == F.size("q")).select("qid", "_id", distance.squared_l2(F.col("v"), F.col("q")).alias("_score"))
    want = search.ranked(met.where("_score is not null and not isnan(_score)"), 4, False)
    key = lambda d: sorted((r.qid, r._rank, r._id) for r in d.collect())
    assert key(got) == key(want) and len(key(got)) == 25
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_graph_holds_one_matrix_of_floats():
    """Of 2,048 rows, the squared distances as floats are 17 MB; as doubles with their terms and orders they were 130 MB or more."""
    import tracemalloc

    x = np.random.default_rng(2).standard_normal((2048, 16))
    tracemalloc.start()
    links = ann.graph(x, 32, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links.shape == (2048, 32) and peak < 60e6


def test_tiles_of_scores_are_small():
    """A task holds several arrays of a tile's scores; with 8 MB each, 4 tasks of an executor stay below 400 MB."""
    assert search.CELLS * 8 * 12 * 4 <= 400e6
