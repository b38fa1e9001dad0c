"""The engine's requests end to end: documents, filters, search, partitions, indexes, versions, catalog."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vekspar.errors import Code, EngineError
from vekspar.plans.catalog import is_slow
from vekspar.plans.engine import Engine
from vekspar.schema import Space

N, D = 120, 8
FIELDS = [
    {"name": "field_int", "type": "integer", "index": {"type": "INVERTED"}},
    {"name": "field_long", "type": "long"},
    {"name": "field_double", "type": "double", "index": {"type": "BITMAP"}},
    {"name": "field_string", "type": "string", "index": {"type": "SCALAR"}},
    {"name": "tags", "type": "string_array", "index": {"type": "SCALAR"}},
    {"name": "day", "type": "date", "index": {"type": "SCALAR"}},
    {"name": "v", "type": "vector", "dimension": D, "index": {"type": "FLAT", "params": {"metric_type": "L2"}}},
]
X = np.random.default_rng(5).standard_normal((N, D)).astype(np.float32)


def doc(i):
    return {"_id": str(i), "field_int": i, "field_long": i, "field_double": float(i), "field_string": str(i % 7), "tags": [str(i), str(i + 1000)], "day": 86400 * i, "v": X[i].tolist()}


def where(field, op, value, how="AND"):
    return {"operator": how, "conditions": [{"field": field, "operator": op, "value": value}]}


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"))
    e.catalog.create_db("db")
    e.create_space("db", {"name": "s", "fields": FIELDS, "partition_num": 3})
    e.upsert("db", "s", [doc(i) for i in range(N)])
    return e


def ids(df):
    return [r["_id"] for r in df.select("_id").collect()]


def test_query_and_fields(engine):
    assert ids(engine.query("db", "s", {"document_ids": ["7", "3", "nope", "5"]})) == ["7", "3", "5"]
    got = engine.query("db", "s", {"filters": where("field_int", "<", 5), "fields": ["field_string"]})
    assert got.columns == ["_id", "field_string"] and sorted(ids(got)) == ["0", "1", "2", "3", "4"]
    assert "v" not in engine.query("db", "s", {"document_ids": ["1"]}).columns
    assert "v" in engine.query("db", "s", {"document_ids": ["1"], "vector_value": True}).columns
    assert engine.query("db", "s", {"filters": where("field_int", ">=", 0)}).count() == 50
    assert ids(engine.query("db", "s", {"filters": where("field_int", ">=", 0), "sort": [{"field_int": "desc"}], "limit": 3})) == ["119", "118", "117"]
    assert ids(engine.query("db", "s", {"filters": where("field_int", ">=", 0), "sort": "field_int", "page_size": 5, "page_num": 2})) == ["5", "6", "7", "8", "9"]
    assert sorted(ids(engine.query("db", "s", {"filters": where("tags", "IN", ["3", "1004"])}))) == ["3", "4"]
    assert ids(engine.query("db", "s", {"filters": where("day", "=", "1970-01-11")})) == ["10"]


@pytest.mark.parametrize(
    ("request_", "code"),
    [
        ({}, Code.QUERY_INVALID_PARAMS_SHOULD_HAVE_ONE_OF_DOCUMENT_IDS_OR_FILTER),
        ({"document_ids": ["1"], "filters": where("field_int", "<", 5)}, Code.QUERY_INVALID_PARAMS_BOTH_DOCUMENT_IDS_AND_FILTER),
        ({"document_ids": [str(i) for i in range(500)]}, Code.QUERY_INVALID_PARAMS_LENGTH_OF_DOCUMENT_IDS_BEYOND_500),
        ({"filters": where("field_long", "<", 5)}, Code.PARAM_ERROR),
        ({"filters": where("field_int", "IN", ["5"])}, Code.PARAM_ERROR),
        ({"filters": where("field_string", "<", "5")}, Code.PARAM_ERROR),
        ({"filters": where("field_int", "LIKE", 5)}, Code.FILTER_CONDITION_OPERATOR_TYPE_ERR),
        ({"filters": where("field_int", "<", 5, "XOR")}, Code.FILTER_OPERATOR_TYPE_ERR),
        ({"filters": where("field_int", "<", 5), "fields": ["nope"]}, Code.PARAM_ERROR),
    ],
)
def test_bad_queries(engine, request_, code):
    with pytest.raises(EngineError) as e:
        engine.query("db", "s", request_)
    assert e.value.code == code


def test_search(engine):
    q = X[[3, 9]].ravel().tolist()
    got = engine.search("db", "s", {"vectors": [{"field": "v", "feature": q}], "limit": 4, "fields": ["field_int"]}).orderBy("qid", "_rank").collect()
    for i, x in enumerate(X[[3, 9]].astype(float)):
        d = ((X.astype(float) - x) ** 2).sum(1)
        want = np.argsort(d)[:4]
        assert [r.field_int for r in got if r.qid == i] == want.tolist()
        assert np.allclose([r._score for r in got if r.qid == i], d[want], atol=1e-8)
    low = engine.search("db", "s", {"vectors": [{"field": "v", "feature": X[3].tolist(), "min_score": -10, "max_score": -1}], "limit": 4})
    assert low.count() == 0
    some = engine.search("db", "s", {"vectors": [{"field": "v", "feature": X[3].tolist()}], "limit": 100, "filters": where("field_int", "<", 10)})
    assert sorted(map(int, ids(some))) == list(range(10))
    paged = engine.search("db", "s", {"vectors": [{"field": "v", "feature": X[3].tolist()}], "limit": 10, "offset": 2})
    assert [r._rank for r in paged.orderBy("_rank").collect()] == list(range(1, 11))
    assert engine.similarity_search("db", "s", "v", X[3].tolist(), 1).first()["_id"] == "3"


def test_upsert_delete(engine):
    status = engine.upsert("db", "s", [{"_id": "3", "field_int": 300}, {"_id": "3", "field_string": "x"}, {"_id": "new"}, {**doc(0), "_id": ""}]).collect()
    assert {r.code for r in status if r._id == "new"} == {int(Code.UPSERT_INVALID_PARAMS)}
    d = engine.get("db", "s", ["3"]).first()
    assert (d.field_int, d.field_string, d.field_long) == (300, "x", 3) and np.allclose(d.v, X[3])
    assert engine.stats("db", "s").first().doc_num == N + 1
    before = d._docid
    engine.delete("db", "s", {"document_ids": ["3", "4"]})
    assert engine.stats("db", "s").first().doc_num == N - 1
    engine.upsert("db", "s", [doc(3)])
    assert engine.get("db", "s", ["3"]).first()._docid > before
    engine.delete("db", "s", {"filters": where("field_int", ">=", 100), "limit": 5})
    assert engine.stats("db", "s").first().doc_num == N - 5
    nxt = engine.query("db", "s", {"document_ids": ["10"], "next": True}).first()
    assert nxt._docid > engine.get("db", "s", ["10"]).first()._docid


@pytest.mark.parametrize("bad", [{"field_int": "x"}, {"field_int": None}, {"v": [1.0] * 7}, {"v": [float("nan")] * D}, {"nope": 1}, {"tags": "a"}, {"field_string": "x" * 2000}])
def test_bad_documents(engine, bad):
    with pytest.raises(EngineError):
        engine.upsert("db", "s", [{**doc(1), **bad}])


def test_index_and_realtime(engine):
    engine.create_space("db", {"name": "t", "fields": [{"name": "n", "type": "integer", "index": {"type": "SCALAR"}}, {"name": "v", "type": "vector", "dimension": D, "index": {"type": "IVFFLAT", "params": {"metric_type": "L2", "ncentroids": 7, "nprobe": 7}}}]})
    rows = [{"_id": str(i), "n": i, "v": X[i % N].tolist()} for i in range(N)]
    engine.upsert("db", "t", rows)
    request = {"vectors": [{"field": "v", "feature": (X[5] + 0.01).tolist()}], "limit": 5}
    with pytest.raises(EngineError) as e:
        engine.search("db", "t", request)
    assert e.value.code == Code.SEARCH_ENGINE_ERR
    exact = ids(engine.search("db", "t", {**request, "is_brute_search": 1}).orderBy("_rank"))
    engine.rebuild_index("db", "t")
    assert ids(engine.search("db", "t", request).orderBy("_rank")) == exact
    engine.upsert("db", "t", [{"_id": "fresh", "n": 1, "v": (X[5] + 0.01).tolist()}])
    engine.delete("db", "t", {"document_ids": [exact[0]]})
    after = ids(engine.search("db", "t", request).orderBy("_rank"))
    assert after == ids(engine.search("db", "t", {**request, "is_brute_search": 2}).orderBy("_rank")) and after[0] == "fresh" and exact[0] not in after


def test_partition_rule(engine):
    rule = {"type": "RANGE", "field": "day", "ranges": [{"name": "a", "value": "1970-01-11"}, {"name": "b", "value": "1970-02-01"}]}
    engine.create_space("db", {"name": "p", "fields": FIELDS, "partition_rule": rule})
    engine.upsert("db", "p", [doc(i) for i in range(30)])
    assert {r.partition_name: r.doc_num for r in engine.stats("db", "p").collect()} == {"a": 10, "b": 20}
    got = engine.query("db", "p", {"filters": where("field_int", ">=", 8), "partition_names": ["a"]})
    assert sorted(ids(got)) == ["8", "9"]
    with pytest.raises(Exception, match="past the last range"):
        engine.upsert("db", "p", [doc(50)])
    engine.change_partitions("db", "p", "ADD", [{"name": "c", "value": "1971-01-01"}])
    engine.upsert("db", "p", [doc(50)])
    engine.change_partitions("db", "p", "DROP", ["a"])
    assert {r.partition_name: r.doc_num for r in engine.stats("db", "p").collect()} == {"b": 20, "c": 1}


def test_versions_and_export(engine, tmp_path):
    engine.backup("db", "s", str(tmp_path / "backup"))
    engine.delete("db", "s", {"document_ids": ["1"]})
    engine.restore("db", "again", str(tmp_path / "backup"))
    assert engine.stats("db", "again").first().doc_num == N and engine.stats("db", "s").first().doc_num == N - 1
    engine.store("db", "s").compact()
    engine.store("db", "s").export_json(str(tmp_path / "out"))
    engine.create_space("db", {"name": "copy", "fields": FIELDS})
    engine.store("db", "copy").import_json(str(tmp_path / "out"))
    a, b = (engine.store("db", n).read().drop("_docid") for n in ("s", "copy"))
    assert a.exceptAll(b).count() == 0 and b.count() == N - 1
    engine.expand("db", "s", 5)
    assert engine.stats("db", "s").first().doc_num == N - 1
    engine.add_fields("db", "s", [{"name": "extra", "type": "integer"}])
    engine.upsert("db", "s", [{"_id": "2", "extra": 9}])
    assert engine.get("db", "s", ["2"]).first().extra == 9


def test_catalog(engine):
    c = engine.catalog
    with pytest.raises(EngineError) as e:
        c.drop_db("db")
    assert e.value.code == Code.DB_NOT_EMPTY
    c.create_alias("nick", "db", "s")
    assert c.space("db", "nick").name == "s" and engine.query("db", "nick", {"document_ids": ["1"]}).count() == 1
    c.create_role("reader", {"ResourceDocument": "ReadOnly"})
    c.create_user("ann", "pw", "reader")
    c.authenticate("ann", "pw")
    c.authorize("ann", "ResourceDocument", False)
    for call in (lambda: c.authenticate("ann", "no"), lambda: c.authorize("ann", "ResourceDocument", True), lambda: c.authorize("ann", "ResourceDB", False), lambda: c.create_user("ann", "pw", "reader")):
        with pytest.raises(EngineError):
            call()
    c.modify_role("reader", "Grant", {"ResourceDocument": "WriteRead"})
    c.authorize("ann", "ResourceDocument", True)
    c.authorize("root", "ResourceUser", True)
    again = Engine(engine.spark, engine.root).catalog
    assert again.spaces("db") == ["s"] and again.alias("nick")["space"] == "s"
    engine.drop_space("db", "s")
    c.drop_db("db")
    assert is_slow(500) and is_slow(10, 80, 800) and is_slow(1, conditions=3) and not is_slow(50, 10, 2048, 1)


@pytest.mark.parametrize(
    "bad",
    [
        {"name": ""}, {"name": "1a"}, {"name": "_a"}, {"name": "a b"}, {"fields": []}, {"fields": [FIELDS[0]]}, {"fields": [FIELDS[-1], FIELDS[-1]]},
        {"fields": [{"name": "_id", "type": "string"}, FIELDS[-1]]}, {"fields": [{"name": "v", "type": "vector"}]}, {"fields": [{"name": "v", "type": "decimal"}]},
        {"indexes": [{"type": "COMPOSITE", "name": "c", "field_names": ["field_int"]}]}, {"indexes": [{"type": "SSG", "name": "c", "field_name": "v"}]},
        {"indexes": [{"type": "HNSW", "name": "c", "field_name": "v", "params": {"nlinks": 4}}]}, {"indexes": [{"type": "IVFFLAT", "name": "c", "field_name": "v", "params": {"ncentroids": 10, "nprobe": 20}}]},
        {"indexes": [{"type": "FLAT", "name": "c", "field_name": "field_int"}]}, {"partition_rule": {"type": "RANGE", "field": "field_int", "ranges": [{"name": "a", "value": "1970-01-11"}]}},
        {"partition_rule": {"type": "RANGE", "field": "day", "ranges": [{"name": "a", "value": "1971-01-11"}, {"name": "b", "value": "1970-01-11"}]}},
    ],
)
def test_bad_spaces(bad):
    with pytest.raises(EngineError):
        Space.parse({"name": "s", "fields": FIELDS, **bad})


def test_stream(engine, spark, tmp_path):
    schema = "_id string, field_int int, _pos long"
    src = str(tmp_path / "in")
    spark.createDataFrame([("1", 77, 0), ("1", 78, 1), ("2", 5, 2)], schema).write.parquet(src)
    q = engine.stream("db", "s", spark.readStream.schema(schema).parquet(src), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert engine.get("db", "s", ["1"]).first().field_int == 78 and engine.get("db", "s", ["2"]).first().field_int == 5
    assert engine.get("db", "s", ["5"]).first().day == dt.datetime(1970, 1, 6)
    assert engine.store("db", "s").read().where(F.col("field_int") == 78).count() == 2


def test_a_crash_between_writes_loses_nothing(engine):
    s = engine.store("db", "s")
    version = s.manifest["version"]
    (s.files).create(f"{s.root}/manifest-{version + 1}.json", '{"version": 2, "buck')  # cut short
    again = engine.store("db", "s")
    assert again.manifest["version"] == version and again.read().count() == N
    engine.delete("db", "s", {"document_ids": ["1"]})
    assert engine.store("db", "s").read().count() == N - 1 and engine.store("db", "s").manifest["version"] == version + 2


def test_of_two_writers_one_wins(engine, spark):
    a, b = engine.store("db", "s"), engine.store("db", "s")
    a.delete(spark.createDataFrame([("1",)], "_id string"))
    with pytest.raises(EngineError):
        b.delete(spark.createDataFrame([("2",)], "_id string"))
    assert sorted(map(int, ids(engine.store("db", "s").read()))) == [0, *range(2, N)]
    one, two = Engine(spark, engine.root), Engine(spark, engine.root)
    one.catalog.create_db("x")
    with pytest.raises(EngineError):
        two.catalog.create_db("y")
    assert Engine(spark, engine.root).catalog.dbs() == ["db", "x"]


def test_background_indexing_and_incremental_refresh(engine, spark):
    import time

    engine.create_space("db", {"name": "b", "partition_num": 4, "refresh_interval": 50, "fields": [{"name": "n", "type": "integer", "index": {"type": "SCALAR"}}, {"name": "v", "type": "vector", "dimension": D, "index": {"type": "HNSW", "name": "h", "params": {"metric_type": "L2"}}}]})
    engine.upsert("db", "b", [{"_id": str(i), "n": i, "v": X[i].tolist()} for i in range(N)])
    assert {r.status for r in engine.indexes("db", "b").collect() if r.name == "h"} == {"UNTRAINED"}
    run = engine.start_indexing("db", "b")
    for _ in range(300):
        if engine.status("db", "b").first().status == "green":
            break
        time.sleep(0.2)
    run.stop()
    assert run.failed is None and {r.status for r in engine.indexes("db", "b").collect() if r.name == "h"} == {"READY"}
    engine.upsert("db", "b", [{"_id": "0", "v": (X[7] + 1e-3).tolist()}])
    d = engine.rebuild_index("db", "b", describe=True).first()
    assert d.trained and 0 < d.changed < d.buckets and engine.status("db", "b").first().status == "yellow"
    q = {"vectors": [{"field": "v", "feature": X[7].tolist()}], "limit": 5, "filters": where("n", "<", 100)}
    exact = ids(engine.search("db", "b", {**q, "is_brute_search": 1}).orderBy("_rank"))
    assert exact[:2] == ["7", "0"] and ids(engine.search("db", "b", q).orderBy("_rank")) == exact
    assert engine.refresh_index("db", "b") == d.changed and engine.refresh_index("db", "b") == 0
    assert ids(Engine(spark, engine.root).search("db", "b", q).orderBy("_rank")) == exact
    assert {r.request: r.calls for r in engine.metrics().collect()}["search"] == 2
    with pytest.raises(EngineError):
        engine.create_space("db", {"name": "c", "fields": [{"name": "v", "type": "vector", "dimension": D, "index": {"type": "SCANN"}}]})


def test_backup_versions(engine, tmp_path):
    at = str(tmp_path / "b")
    assert engine.backup("db", "s", at) == 1
    engine.delete("db", "s", {"document_ids": ["1"]})
    assert engine.backup("db", "s", at) == 2
    assert [tuple(r) for r in engine.backups(at).collect()] == [(1, "COMPLETED", N), (2, "COMPLETED", N - 1)]
    engine.restore("db", "one", at, 1)
    engine.delete_backup(at, 1)
    with pytest.raises(EngineError):
        engine.restore("db", "two", at, 1)
    assert engine.stats("db", "one").first().doc_num == N


def test_data_frames_are_normalized(spark, engine):
    """As documents are, in the tasks, with the driver holding none."""
    engine.create_space("db", {"name": "unit", "fields": [{"name": "v", "type": "vector", "dimension": D, "format": "normalization"}]})
    rows = spark.createDataFrame([(str(i), (3 * x).tolist()) for i, x in enumerate(X)], "_id string, v array<double>")
    engine.upsert("db", "unit", rows)
    got = {r._id: np.array(r.v) for r in engine.store("db", "unit").read().collect()}
    assert all(np.allclose(got[str(i)], x / np.linalg.norm(x), atol=1e-6) for i, x in enumerate(X)) and len(got) == N
    engine.create_space("db", {"name": "unit2", "fields": [{"name": "v", "type": "vector", "dimension": D, "format": "normalization"}]})
    engine.upsert("db", "unit2", [{"_id": str(i), "v": (3 * x).tolist()} for i, x in enumerate(X)])
    assert all(np.allclose(got[r._id], r.v, atol=1e-7) for r in engine.store("db", "unit2").read().collect())
