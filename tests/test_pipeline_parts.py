import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom.config import ConfigError, Settings
from ragloom.operators import answering, embedding, indexing, markdown, retrieval
from ragloom.sources import records, store, zipdocs
from ragloom.streaming import incremental


def test_settings():
    assert Settings.from_env({"RAGLOOM_MAX_CHUNK_SIZE": "50", "RAGLOOM_MIN_CHUNK_SIZE": "10", "RAGLOOM_EXPAND_PARENTS": "false"}).expand_parents is False
    for env in ({"RAGLOOM_MIN_CHUNK_SIZE": "500"}, {"RAGLOOM_DEFAULT_TOP_K": "101"}, {"RAGLOOM_RUN_CAP": "x"}, {"RAGLOOM_EMBEDDING_RETRY_BASE_MS": "30000"}):
        with pytest.raises(ConfigError):
            Settings.from_env(env)


def make_zip(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)


def test_zip_scan_to_documents(spark, tmp_path):
    make_zip(tmp_path / "a.zip", {"intro.md": "---\ntitle: Intro\nlang: fr\n---\n# Other\n\n[x](http://x)\n\n```bash\nls\n```\n", "guide/s.md": "# Setup\n\n## A\n\n## B\n", "bad.md": "---\na: [\n---\nx", "notes.txt": "no"})
    entries = zipdocs.scan_archives(spark, str(tmp_path))
    assert {r["sourcePath"] for r in entries.collect()} == {"intro.md", "guide/s.md", "bad.md"}
    docs = {r["sourcePath"]: r for r in zipdocs.structured_documents(entries).collect()}
    assert (docs["intro.md"]["title"], docs["intro.md"]["language"]) == ("Intro", "fr")
    assert docs["intro.md"]["codeBlocks"][0]["content"] == "ls\n"
    assert docs["guide/s.md"]["title"] == "Setup" and [h["parentIdx"] for h in docs["guide/s.md"]["headings"]] == [-1, 0, 0]
    assert docs["bad.md"]["error"] and docs["intro.md"]["error"] is None


def test_zip_guards(spark, tmp_path):
    make_zip(tmp_path / "a.zip", {f"{i}.md": "x" * 10 for i in range(5)})
    for limits in ({"max_entries": 4}, {"max_bytes": 40}):
        with pytest.raises(Exception, match="ArchiveError"):
            zipdocs.scan_archives(spark, str(tmp_path), **limits).collect()
    with pytest.raises(zipdocs.ArchiveError):
        zipdocs.check_entry_name("../x")


def candidates(spark):
    rows = [(f"c{i}", "d", i, "parent" if i == 0 else "child", [("h",)], " " if i == 1 else f"text {i}", f"h{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "chunkId string, documentId string, sequenceIndex int, chunkType string, headingPath array<struct<text:string>>, text string, contentHash string")
    return embedding.with_embedding_ids(embedding.embedding_inputs(df, heading_context=False), "fake", "m", "1", 4)


def test_embedding_accounts_add_up(spark):
    all_rows = candidates(spark)
    existing = all_rows.where("sequenceIndex in (2, 3)").select("embeddingId")
    counts = embedding.accounting(embedding.run_status(all_rows, existing, ["child"], cap=4)).first().asDict()
    assert counts == {"scanned": 10, "skippedByType": 1, "skippedEmpty": 1, "alreadyEmbedded": 2, "skippedByCap": 2, "attempted": 4}


def test_failed_batches_fail_their_rows_only(spark):
    def provider(texts):
        if any("5" in t for t in texts):
            raise ValueError("no")
        return [[0.0, 1.0, 2.0, 3.0] for _ in texts]

    pending = candidates(spark).where("input is not null").coalesce(1)
    done = embedding.embed_with(pending, provider, 4, batch_size=3).persist()
    assert done.where("error is not null").count() == 3 and done.where("size(vector) = 4").count() == 6
    assert embedding.check_failures(done, F.col("error").isNotNull()) == (3, 9)
    with pytest.raises(embedding.FailureRatioExceeded):
        embedding.check_failures(done, F.col("error").isNotNull(), 0.3)
    done.unpersist()


def test_retry_pauses():
    pauses, calls = [], []

    def call():
        calls.append(1)
        raise embedding.TransientProviderError("x", 50_000 if len(calls) == 2 else None)

    with pytest.raises(embedding.TransientProviderError):
        embedding.with_retry(call, 4, 100, 250, pauses.append, lambda: 1.0)
    assert pauses == [0.1, 0.25, 0.25] and len(calls) == 4


def test_resumption_passes_over_a_broken_last_line(spark, tmp_path):
    line = '{"embeddingId":"e%d","provider":"fake","model":"m","modelVersion":"1","dimensions":4,"vector":[1.0]}\n'
    (tmp_path / "r.jsonl").write_text(line % 1 + "\n" + line % 2 + '{"embeddingId": "e3", "prov')
    found = records.existing_ids(spark, str(tmp_path / "r.jsonl"), "fake", "m", "1", 4)
    assert {r[0] for r in found.collect()} == {"e1", "e2"}
    assert records.existing_ids(spark, str(tmp_path / "none"), "fake", "m", "1", 4).count() == 0
    with pytest.raises(records.RecordError):
        records.existing_ids(spark, str(tmp_path / "r.jsonl"), "fake", "other", "1", 4)
    (tmp_path / "bad.jsonl").write_text("nonsense\n" + line % 1)
    with pytest.raises(records.RecordError):
        records.existing_ids(spark, str(tmp_path / "bad.jsonl"), "fake", "m", "1", 4)


def test_store(spark, tmp_path):
    collections = store.Collections(spark, str(tmp_path))
    assert collections.info("c") is None
    with pytest.raises(store.StoreError):
        collections.read("c")
    collections.ensure("c", 2)
    collections.ensure("c", 2)
    with pytest.raises(store.StoreError):
        collections.ensure("c", 3)
    schema = "id string, vector array<double>, documentId string, seq long"
    collections.upsert("c", spark.createDataFrame([("a", [1.0, 0.0], "x", 1), ("a", [0.0, 1.0], "x", 2), ("b", [1.0, 1.0], None, 1)], schema))
    collections.upsert("c", spark.createDataFrame([("b", [3.0, 3.0], "y", 1)], schema))
    assert {r["id"]: r["vector"] for r in collections.read("c").collect()} == {"a": [0.0, 1.0], "b": [3.0, 3.0]}
    with pytest.raises(store.StoreError):
        collections.delete("c", None)
    assert collections.delete("c", F.col("documentId") == "x") == 1
    assert collections.info("c") == {"dimensions": 2, "count": 1}


def test_retrieval_limits_and_ties(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, vector array<double>")
    assert [r["id"] for r in retrieval.top_k(points, [2.0, 0.0], 3).collect()] == ["a", "b", "c"]
    assert retrieval.top_k(points, [1.0, 0.0], 5, threshold=1.0).count() == 2
    with pytest.raises(retrieval.RetrievalError):
        retrieval.top_k_limit(101)
    for bad in (None, " ", "x" * 2001):
        with pytest.raises(retrieval.RetrievalError):
            retrieval.valid_question(bad)
    many = spark.range(300).select(F.col("id").alias("queryId"), F.array(F.lit(1.0), F.lit(0.0)).alias("queryVector"))
    assert retrieval.batch_top_k(points, many, 2).count() == 600


def test_ask_refuses_without_context(spark):
    results = spark.createDataFrame([(1, "c1", 0.9, 0, "body", None, "T", "A › B", "p.md"), (1, "c1", 0.95, 1, "body", "parent body", "T", "A › B", "p.md"), (2, "c2", 0.1, 0, "low", None, "", "", "")], "queryId long, chunkId string, score double, position long, text string, parentText string, documentTitle string, headingPath string, sourcePath string")
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "queryId long, question string")
    rows = {r["queryId"]: r for r in answering.ask(asked, results, min_score=0.5).collect()}
    assert (rows[1]["reason"], rows[1]["cited"]) == (None, ["S1"]) and rows[1]["costUsd"] > 0
    assert (rows[2]["reason"], rows[3]["reason"]) == ("below_threshold", "no_results") and rows[2]["answer"] == answering.NO_ANSWER and rows[2]["costUsd"] is None
    context = answering.select_context(results, min_score=0.5)
    assert context.first()["text"] == "parent body"
    cited = answering.citations(spark.createDataFrame([(1, "x [S1, S9] [S1]")], "queryId long, answer string"), context).collect()
    assert [(c["sourceId"], c["title"]) for c in cited] == [("S1", "T")]


def test_stream_is_idempotent(spark, tmp_path):
    schema = "chunkId string, documentId string, sequenceIndex int, chunkType string, headingPath array<struct<text:string>>, text string, contentHash string"
    rows = [(f"c{i}", "d", i, "child", [("h",)], f"text {i}", f"h{i}") for i in range(4)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    collections = store.Collections(spark, str(tmp_path / "store"))

    def to_points(df):
        return indexing.points(df.withColumns({"parentChunkId": F.lit(None).cast("string"), "parentText": F.lit(None).cast("string")}), "docs")

    for checkpoint in ("k1", "k2"):
        stream = incremental.chunk_stream(spark, str(tmp_path / "in"), schema)
        incremental.start(stream, collections, "c", str(tmp_path / checkpoint), to_points, 4).awaitTermination(90)
        assert collections.info("c") == {"dimensions": 4, "count": 4}


def test_texts_are_parsed_in_slices_of_bounded_size(spark):
    texts = ["# A\n\n" + "x" * n for n in (10, 700_000, 700_000, 3_000_000, 0, 5)] + [None, ""] + ["# B"] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "body"])
    made = list(markdown.small_batches(iter([batch]), 1))
    assert pa.Table.from_batches(made).equals(pa.Table.from_batches([batch]))
    assert all(b.num_rows <= markdown.SLICE_ROWS and (b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= markdown.SLICE_BYTES) for b in made)
    assert list(markdown.small_batches(iter([batch.slice(0, 0)]), 1)) == []
    seen = []
    outline, split = markdown.outlines, zipdocs.split_front_matter

    class Documents:
        """Stands for a table with one text column whose batch is run here."""

        def __init__(self, name):
            self.columns, self.schema = [name], spark.createDataFrame([("",)], f"{name} string").schema

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802 - Spark's name
            seen.append([b.num_rows for b in run(iter([batch.select(["body"])]))])

    outline(Documents("body"))
    split(Documents("raw"))
    assert all(sum(rows) == len(texts) and max(rows) <= markdown.SLICE_ROWS for rows in seen) and len(seen) == 2


def test_records_without_a_parent_are_not_dealt_together(spark):
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for name, value in zip(held, ("false", "-1", "8"), strict=True):
        spark.conf.set(name, value)
    try:
        ids = spark.range(800).select(F.col("id").cast("string").alias("chunkId"))
        chunks = ids.select("chunkId", F.when(F.col("chunkId") == "7", "5").when(F.col("chunkId") == "8", "gone").alias("parentChunkId"), F.lit("child").alias("chunkType"), F.lit(None).cast("array<struct<text:string>>").alias("headingPath"), F.concat(F.lit("t"), "chunkId").alias("text"))
        records = ids.select("chunkId", F.lit("fake").alias("provider"), F.lit("m").alias("model"), F.lit("1").alias("modelVersion"), F.lit(1).alias("dimensions"), F.array(F.lit(1.0)).alias("vector"))
        status = indexing.index_status(records, chunks, indexing.rejection("fake", "m", "1", 1, allow_fake=True))
        rows = status.withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) == 800 and {r["status"] for r in rows} == {"indexed"} and {r["chunkId"]: r["parentText"] for r in rows if r["parentText"]} == {"7": "t5"}
        assert max(Counter(r["task"] for r in rows).values()) < 200
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
