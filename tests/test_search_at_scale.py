"""Blocked search and the inverted lists against plain products; resumption by the id index."""

import json

import numpy as np
import pytest
from ragloom.operators import ann, retrieval
from ragloom.sources import records


def table(spark, x, name="id", vector="vector"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, {vector} array<double>")


def plain(x, q, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(q) @ unit(x).T, 12)
    return [[int(i) for i in np.lexsort((np.arange(len(x)), -s))[:k]] for s in scores]


def ids_of(df):
    out = {}
    for r in df.orderBy("queryId", "rank").collect():
        out.setdefault(r["queryId"], []).append(r["id"])
    return out


def test_blocks_of_both_sides_give_what_one_product_gives(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, q = rng.integers(-2, 3, (700, 6)).astype(float), rng.integers(-2, 3, (90, 6)).astype(float)
    for size in (16 << 20, 4000):  # one cell, and many
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", size)
        found = retrieval.batch_top_k(table(spark, x), table(spark, q, "queryId", "queryVector"), 5)
        got = ids_of(found)
        want = plain(x, q, 5)
        zero = ~q.any(axis=1)
        assert all(got[i] == (w if not zero[i] else [0, 1, 2, 3, 4]) for i, w in enumerate(want))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan


def clustered(n, centres=12, size=16, seed=5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, size))
    share = np.array([0.4, *[0.6 / (centres - 1)] * (centres - 1)])  # one hot cluster
    return c[rng.choice(centres, n, p=share)] + 0.35 * rng.normal(size=(n, size))


def test_lists_reach_the_recall_and_cover_every_point(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 16 << 10)  # lists are cut into blocks
    x, q = clustered(4000), clustered(120, seed=6)
    points = table(spark, x)
    built = ann.build(spark, points, str(tmp_path / "index"), lists=40, recall=0.9)
    index = ann.open_index(spark, str(tmp_path / "index"))
    assert index.points.count() == 4000 and index.points.select("list").distinct().count() > 20
    assert index.probes == built.probes and 1 <= index.probes < 40
    queries = table(spark, q, "queryId", "queryVector")
    exact = retrieval.batch_top_k(points, queries, 10)
    found = index.search(queries, 10)
    assert ann.recall(found, exact) >= 0.9
    assert ids_of(index.search(queries, 10, exact=True)) == ids_of(exact)
    scores = {(r["queryId"], r["id"]): r["score"] for r in exact.collect()}
    assert all(abs(r["score"] - scores[r["queryId"], r["id"]]) < 1e-12 for r in found.collect() if (r["queryId"], r["id"]) in scores)
    assert index.search(queries, 3, threshold=2.0).count() == 0


def test_odd_points(spark, tmp_path):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(40, [0.0, 0.0]), (41, None), (None, [1.0, 1.0]), (42, [1.0]), (43, [None, 1.0]), (44, [])]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [2.0]), (None, [1.0, 1.0]), (4, None)], "queryId long, queryVector array<double>")
    exact = retrieval.batch_top_k(points, queries, 4)
    assert {q: len(v) for q, v in ids_of(exact).items()} == {1: 4, 2: 4, 3: 1}
    index = ann.build(spark, points, str(tmp_path / "i"), lists=3)
    assert ids_of(index.search(queries, 4, exact=True)) == ids_of(exact)
    empty = ann.build(spark, points.limit(0), str(tmp_path / "e"))
    assert empty.search(queries, 4).count() == 0 and ann.open_index(spark, str(tmp_path / "e")).search(queries, 2).count() == 0


RECORD = {"chunkId": "c", "documentId": "d", "sourcePath": None, "vector": [0.5, 1.0], "dimensions": 2, "provider": "p", "model": "m", "modelVersion": "1", "contentHash": "h", "inputHash": "i", "inputTokenCount": 1, "truncated": False}


def lines(ids):
    return "".join(json.dumps({"embeddingId": i, **RECORD}) + "\n" for i in ids)


def test_resumption_reads_identities_only(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    (folder / "a.json").write_text(lines(["e1", "e2"]))
    (folder / "b.json").write_text(lines(["e3"]) + '{"embeddingId": "e4", "vec')  # a broken-off append
    known = lambda: records.existing_ids(spark, str(folder), "p", "m", "1", 2)
    assert {r[0] for r in known().collect()} == {"e1", "e2", "e3"}
    plan = known()._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan and "FileScan text" not in plan and "FileScan json" not in plan
    (folder / "c.json").write_text(lines(["e5"]))
    (folder / "b.json").write_text(lines(["e3", "e6"]))
    assert {r[0] for r in known().collect()} == {"e1", "e2", "e3", "e5", "e6"}
    with pytest.raises(records.RecordError):
        records.existing_ids(spark, str(folder), "p", "other", "1", 2)
    (folder / "d.json").write_text("nonsense\n" + lines(["e7"]))
    with pytest.raises(records.RecordError):
        known()
    assert records.read_records(spark, str(folder / "a.json")).count() == 2
