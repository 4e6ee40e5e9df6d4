"""Caps by ranges, calls that are told to stop, streams that go on from their checkpoint, and data skipping."""

import random
import threading
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from ragloom.operators import embedding, indexing, retrieval
from ragloom.sources import store
from ragloom.streaming import incremental


def test_first_rows_are_those_of_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, f"d{rng.randrange(50)}"]), rng.choice([None, rng.randrange(6)])) for _ in range(700)]
    df = spark.createDataFrame(rows, "d string, s int").repartition(7)
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)
    want = sorted(rows, key=key)
    for cap in (1, 2, 99, 350, 699, 700, 5000):
        assert sorted(map(tuple, embedding.first_rows(df, ["d", "s"], cap).collect()), key=key) == want[:cap]
    plan = embedding.first_rows(df, ["d", "s"], 99)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_a_late_call_is_told_to_stop():
    ended = []

    def slow(token):
        try:
            token.wait(30)
        finally:
            ended.append(time.monotonic())

    before = threading.active_count()
    began = time.monotonic()
    with pytest.raises(embedding.TransientProviderError, match="timed out"):
        embedding.within(0.1, slow)
    assert ended and ended[0] - began < 5
    time.sleep(0.1)
    assert threading.active_count() <= before
    closed = []

    def blocked(token):
        gate = threading.Event()
        token.on_cancel(lambda: (closed.append(1), gate.set()))
        gate.wait(30)

    with pytest.raises(embedding.TransientProviderError):
        embedding.within(0.1, blocked)
    assert closed == [1]

    def fails():
        raise TimeoutError("the provider's own")

    with pytest.raises(TimeoutError, match="own"):
        embedding.within(5, fails)


def test_a_provider_gets_the_token(spark):
    def make():
        def provider(texts, cancel):
            if "slow" in texts[0]:
                cancel.wait(60)
            return [[1.0, 2.0] for _ in texts]

        return provider

    df = spark.createDataFrame([("fast", 1), ("slow", 1)], "input string, tokenCount int").repartition(1)
    began = time.monotonic()
    rows = {r["input"]: r for r in embedding.embed_with(df, make(), 2, batch_size=1, attempts=2, base_ms=1, most_ms=2, timeout_s=0.3).collect()}
    assert rows["fast"]["vector"] == [1.0, 2.0] and "timed out" in rows["slow"]["error"] and time.monotonic() - began < 30


SCHEMA = "chunkId string, documentId string, sequenceIndex int, chunkType string, headingPath array<struct<text:string>>, text string, contentHash string, at timestamp"


def to_points(df):
    return indexing.points(df.withColumns({"parentChunkId": F.lit(None).cast("string"), "parentText": F.lit(None).cast("string")}), "docs")


@pytest.mark.parametrize("watermark", [None, ("at", "1 hour")])
def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path, watermark):
    write = lambda ids: spark.createDataFrame([(f"c{i}", "d", i, "child", [("h",)], f"text {i}", f"h{i}") for i in ids], SCHEMA.rsplit(",", 1)[0]).withColumn("at", F.lit("2026-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    collections = store.Collections(spark, str(tmp_path / "store"))

    def run():
        stream = incremental.chunk_stream(spark, str(tmp_path / "in"), SCHEMA)
        incremental.start(stream, collections, "c", str(tmp_path / "k"), to_points, 4, watermark=watermark).awaitTermination(120)
        return collections.snapshot("c").number, collections.info("c")["count"]

    write([0, 1, 1, 2])
    assert run() == (2, 3)  # the creation and one upsert
    write([1, 2, 0])
    assert run() == (2, 3)  # the state knows them: nothing is embedded or written
    write([2, 3])
    assert run() == (3, 4)
    only = [c for c in collections.snapshot("c").deltas if c["number"] == 3]
    assert spark.read.parquet(only[0]["path"]).count() == 1


def test_a_restricted_search_passes_over_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP_BYTES", 4096)
    collections = store.Collections(spark, str(tmp_path))
    collections.ensure("c", 8)
    rng = random.Random(1)
    rows = [(f"p{i}", [rng.random() for _ in range(8)], f"doc{i % 400:03d}", f"path/{i % 400:03d}.md", "x" * 50, 0) for i in range(40_000)]
    rng.shuffle(rows)
    collections.upsert("c", spark.createDataFrame(rows, "id string, vector array<double>, documentId string, sourcePath string, text string, seq long").coalesce(1))
    collections.compact("c")
    groups = hit = 0
    for part in collections.snapshot("c").base.values():
        for file in spark.read.parquet(part["path"]).inputFiles():
            meta = pq.ParquetFile(file.removeprefix("file:").replace("///", "/")).metadata
            at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("sourcePath")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                groups += 1
                hit += stats.min <= "path/123.md" <= stats.max
    assert groups > 160 and hit < groups / 10
    found = collections.read("c").where(retrieval.payload_filter(sourcePath="path/123.md"))
    assert found.count() == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sourcePath,path/123.md)" in plan
