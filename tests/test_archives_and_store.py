"""The archive source (parts, guards, pruning) and merge-on-read collections (writers, lost work, compaction)."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F
from ragloom.config import Settings
from ragloom.engine import Engine
from ragloom.sources import store, zipdocs


def write_zip(path, files, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in files:
            z.writestr(name, content)


def test_a_large_archive_is_read_in_parts(spark, tmp_path):
    rng = random.Random(1)
    files = [(f"docs/{i:03d}.md", rng.randbytes(rng.randrange(5000))) for i in range(120)] + [("docs/", b""), ("other/skip.txt", b"z" * 9000), ("empty.md", b"")]
    write_zip(tmp_path / "big.zip", files)
    write_zip(tmp_path / "stored.zip", [("a.md", b"plain"), ("b.txt", b"no")], zipfile.ZIP_STORED)
    found = zipdocs.scan_archives(spark, str(tmp_path), partition_bytes=20_000)
    assert found.rdd.getNumPartitions() > 10
    rows = {r["sourcePath"]: bytes(r["content"]) for r in found.collect()}
    assert rows == {n: c for n, c in [*files, ("a.md", b"plain")] if n.endswith(".md")}
    assert {r["sourcePath"]: bytes(r["content"]) for r in zipdocs.scan_archives(spark, f"file://{tmp_path}").collect()} == rows
    only = zipdocs.scan_archives(spark, str(tmp_path / "big.zip"), glob="docs/00?.md", partition_bytes=20_000)
    assert only.count() == 10 and only.rdd.getNumPartitions() < 4  # pruned while planning
    totals = {r["archive"].split("/")[-1]: r["totalEntries"] for r in zipdocs.archive_totals(spark, str(tmp_path)).collect()}
    assert totals == {"big.zip": 123, "stored.zip": 2}


@pytest.mark.parametrize("parts", [20, 1 << 20])
def test_guards_hold_however_an_archive_is_split(spark, tmp_path, parts):
    write_zip(tmp_path / "a.zip", [("a.md", b"x" * 500), ("b.txt", b"y" * 500)])
    with pytest.raises(Exception, match="over 1"):
        zipdocs.scan_archives(spark, str(tmp_path), max_entries=1, partition_bytes=parts).collect()
    with pytest.raises(Exception, match="bytes uncompressed"):
        zipdocs.scan_archives(spark, str(tmp_path), max_bytes=999, partition_bytes=parts).collect()
    write_zip(tmp_path / "a.zip", [("a.md", b"x" * 500), ("../b.txt", b"y")])
    with pytest.raises(Exception, match="unsafe entry name"):
        zipdocs.scan_archives(spark, str(tmp_path), partition_bytes=parts).collect()
    write_zip(tmp_path / "a.zip", [("a.md", bytes(range(256)) * 4)], zipfile.ZIP_STORED)
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[200] ^= 1
    (tmp_path / "a.zip").write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        zipdocs.scan_archives(spark, str(tmp_path), partition_bytes=parts).collect()
    (tmp_path / "a.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="ArchiveError"):
        zipdocs.scan_archives(spark, str(tmp_path), partition_bytes=parts).collect()


def test_equal_paths_broken_documents_and_an_empty_collection(spark, tmp_path):
    write_zip(tmp_path / "a.zip", [("README.md", "# Old\n\nold text\n\n## Two\n\nold two"), ("x.md", "# X\n\nx text")])
    write_zip(tmp_path / "b.zip", [("README.md", "# First\n\nfirst"), ("README.md", "# New\n\nnew text\n\n## Two\n\nnew two"), ("deep.md", "# Deep\n\n" + ">" * 3000 + " q"), ("bad.md", "---\na: [\n---\n# B")])
    engine = Engine(spark, store.Collections(spark, str(tmp_path / "s")), Settings(embedding_dimensions=8, allow_fake_provider=True, min_chunk_size=1))
    documents = engine.documents(str(tmp_path))
    assert sorted((r["sourcePath"], r["title"]) for r in documents.collect()) == [("README.md", "New"), ("bad.md", "bad.md"), ("deep.md", "Deep"), ("x.md", "X")]
    summary = engine.summary(str(tmp_path), documents).first()
    assert (summary["totalEntries"], summary["matched"], summary["failed"]) == (6, 4, 1) and summary["failures"][0]["sourcePath"] == "bad.md"
    chunks = engine.chunks(documents)
    readme = chunks.where("sourcePath = 'README.md'").collect()
    assert len(readme) == len({r["chunkId"] for r in readme}) == 4 and all("old" not in r["text"] and r["documentTitle"] == "New" for r in readme)
    questions = spark.createDataFrame([(1, "q"), (2, None)], "queryId long, question string")
    engine.store.ensure(engine.collection, 8)
    assert engine.search(questions).count() == 0
    assert {r["reason"] for r in engine.ask(questions).collect()} == {"no_results"}
    path = str(tmp_path / "records")
    first = engine.embed(chunks.unionByName(chunks.where("sourcePath = 'x.md'")), path).first()  # some chunks twice
    assert first["failed"] == 0 and first["succeeded"] == first["attempted"] == chunks.where("chunkType = 'child'").count()
    assert engine.index(path, chunks).first()["succeeded"] == first["succeeded"]
    assert engine.search(questions, top_k=2).count() == 2


def points(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<double>, label long, seq long")


def labels(collections, name="c"):
    return {r["id"]: r["label"] for r in collections.read(name).collect()}


def test_a_change_writes_only_itself(spark, tmp_path):
    collections = store.Collections(spark, str(tmp_path))
    collections.ensure("c", 1)
    collections.upsert("c", points(spark, [(f"p{i}", [1.0], i, 0) for i in range(500)]))
    before = {p for p in (tmp_path / "c" / "data").rglob("*.parquet")}
    collections.upsert("c", points(spark, [("p1", [1.0], -1, 0), ("new", [1.0], -2, 0)]))
    added = {p for p in (tmp_path / "c" / "data").rglob("*.parquet")} - before
    assert before and sum(spark.read.parquet(str(p)).count() for p in added) == 2
    assert collections.delete("c", F.col("label") == 7) == 1 and collections.delete("c", F.col("label") == 7) == 0
    assert labels(collections) == {**{f"p{i}": i for i in range(500) if i != 7}, "p1": -1, "new": -2}


def test_compaction_keeps_points_and_untouched_buckets(spark, tmp_path):
    collections, rng, model = store.Collections(spark, str(tmp_path)), random.Random(4), {}
    collections.ensure("c", 1)
    for step in range(9):
        rows = {f"p{rng.randrange(60)}": step * 100 + k for k in range(rng.randrange(1, 8))}
        collections.upsert("c", points(spark, [(i, [1.0], v, 0) for i, v in rows.items()]))
        model |= rows
        if step % 3 == 1:
            gone = rng.choice(list(model.values()))
            collections.delete("c", F.col("label") == gone)
            model = {i: v for i, v in model.items() if v != gone}
        if step in (3, 6):
            kept = collections.snapshot("c").base
            touched = collections.compact("c")
            now = collections.snapshot("c")
            assert not now.deltas and all(now.base.get(b) == p for b, p in kept.items() if int(b) not in touched)
        assert labels(collections) == model
    assert collections.compact("c") and collections.compact("c") == []
    assert collections.vacuum("c", hours=1) == 0 and collections.vacuum("c", hours=-1) > 0
    assert labels(collections) == model and collections.info("c") == {"dimensions": 1, "count": len(model)}


def test_two_writers_cannot_take_one_commit(spark, tmp_path):
    log = store.Log(spark, f"file://{tmp_path}/log")
    assert log.commit(1, {"kind": "create", "dimensions": 1, "buckets": 4}) and not log.commit(1, {"kind": "create", "dimensions": 2, "buckets": 4})
    assert [c["dimensions"] for c in log.read()] == [1] and not [p for p in (tmp_path / "log").iterdir() if "json" not in p.name]
    one, other = store.Collections(spark, str(tmp_path)), store.Collections(spark, str(tmp_path))
    one.ensure("c", 1)
    with pytest.raises(store.StoreError):
        other.ensure("c", 2)
    one.upsert("c", points(spark, [("a", [1.0], 1, 0), ("b", [1.0], 2, 0)]))
    # The other writer's upsert comes in after the first has read where the collection stands.
    append = one._append

    def slow(name, rows, buckets):
        part = append(name, rows, buckets)
        if slow.first:
            slow.first = False
            other.upsert("c", points(spark, [("b", [1.0], 9, 0), ("z", [1.0], 2, 0)]))
        return part

    one._append, slow.first = slow, True
    one.upsert("c", points(spark, [("b", [1.0], 3, 0)]))
    assert labels(one) == labels(other) == {"a": 1, "b": 3, "z": 2}  # both are in, in the order of their commits
    slow.first = True
    assert one.delete("c", F.col("label") == 2) == 1  # found anew: z, and what the other wrote meanwhile
    assert labels(one) == {"a": 1, "b": 9}
    slow.first = True
    assert one.compact("c") and labels(one) == {"a": 1, "b": 9, "z": 2}


def test_work_without_a_commit_is_not_seen(spark, tmp_path):
    collections = store.Collections(spark, str(tmp_path))
    collections.ensure("c", 1)
    collections.upsert("c", points(spark, [("a", [1.0], 1, 0)]))
    broken = points(spark, [("b", [1.0], 2, 0), ("c", [1.0], 3, 0)]).withColumn("label", F.when(F.col("id") == "c", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        collections.upsert("c", broken)
    with pytest.raises(Exception, match="needs an id"):
        collections.upsert("c", points(spark, [(None, [1.0], 1, 0)]))
    assert labels(collections) == {"a": 1}
