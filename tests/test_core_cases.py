"""Cases that the driver's tables do not hold: astral text, ties, bad bytes, answers out of order, and the whole way from bodies to answers."""

import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from ragloom.functions import folds, ids, text
from ragloom.operators import answering, chunking, embedding, indexing, markdown, retrieval
from ragloom.sources import records, store, zipdocs


def units(s):
    return len(s.encode("utf-16-le")) // 2


def test_cuts_count_utf16_units(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é", "\U0001f600", " ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", *[text.utf16_prefix(F.col("t"), n).alias(f"p{n}") for n in (0, 1, 2, 5, 13)], text.truncate_words(F.col("t"), 2).alias("c"))
    for r in df.collect():
        for n in (0, 1, 2, 5, 13):
            cut = r[f"p{n}"]
            assert r["t"].startswith(cut) and units(cut) <= n and (cut == r["t"] or units(r["t"][: len(cut) + 1]) > n)
        assert r["c"]["truncated"] == (units(r["t"]) > 8)
        if units(r["t"]) > 8:
            head = max((k for k in range(len(r["t"])) if r["t"][k] in " \n" and units(r["t"][: k + 1]) <= 8 and r["t"][:k] != ""), default=None)
            after = min((k for k in range(len(r["t"])) if r["t"][k] in " \n" and units(r["t"][: k + 1]) > 8), default=None)
            at = head if head is not None else after
            assert r["c"]["text"] == (r["t"] if at is None else r["t"][:at].rstrip())


def test_budget_counts_utf16_units(spark):
    results = spark.createDataFrame([(1, "a", 0.9, 0, "\U0001f600" * 4, None, "", "", ""), (1, "b", 0.8, 1, "\U0001f600" * 4, None, "", "", "")], "queryId long, chunkId string, score double, position long, text string, parentText string, documentTitle string, headingPath string, sourcePath string")
    rows = answering.select_context(results, max_chars=11).orderBy("rank").collect()
    assert [r["text"] for r in rows] == ["\U0001f600" * 4, "\U0001f600"]


def plain_bins(lengths, most, initial, most_count):
    out, bin_, n, size = [], 0, 0, initial
    for x in lengths:
        if n and (size + x > most or (most_count and n >= most_count)):
            bin_, n, size = bin_ + 1, 0, initial
        n, size = n + 1, size + x
        out.append(bin_)
    return out


def plain_groups(items, most):
    out, group, run, size = [], -1, False, 0
    for eligible, length in items:
        if eligible and run and size + length <= most:
            size += length
        else:
            group, size = group + 1, length
        run = eligible
        out.append(group)
    return out


def test_folds_match_a_plain_loop(spark):
    rng = random.Random(2)
    cases = [[(rng.random() < 0.7, rng.randint(0, 30)) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 129, 1000)] + [None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<struct<eligible:boolean,length:int>>")
    lengths = F.transform("s", lambda x: x["length"])
    rows = df.select("i", folds.greedy_bins(lengths, 50).alias("a"), folds.greedy_bins(lengths, 50, 7, 3).alias("b"), folds.sibling_groups(F.col("s"), 50).alias("g")).collect()
    for r in rows:
        case = cases[r["i"]]
        if case is None:
            assert r["a"] is None and r["g"] is None
            continue
        sizes = [x for _, x in case]
        assert (r["a"], r["b"], r["g"]) == (plain_bins(sizes, 50, 0, None), plain_bins(sizes, 50, 7, 3), plain_groups(case, 50))


def test_the_cap_holds_at_ties(spark):
    rows = [(f"e{i % 4}", "d", 0, "c", "child", "x") for i in range(7)] + [("e9", "d", 0, "c", "parent", "x"), ("e8", "a", 0, "c", "child", None), ("e7", None, None, None, "child", "x")]
    df = spark.createDataFrame(rows, "embeddingId string, documentId string, sequenceIndex int, chunkId string, chunkType string, input string")
    none = df.where("false").select("embeddingId")
    for cap in range(1, 9):
        counts = embedding.accounting(embedding.run_status(df, none, ["child"], cap)).first()
        assert counts["attempted"] == min(cap, 8) and counts["scanned"] == 10 and counts["skippedByCap"] == 8 - min(cap, 8)


def test_names_directories_and_bad_bytes(spark, tmp_path):
    names = ["a/b.md", "a:b.md", "../x", "a/../../x", "a/..", "/x", "\\x", "a\\..\\..\\x", "a\0b", "..a", "./x"]
    column = [r["s"] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", text.is_safe_entry(F.col("n")).alias("s")).orderBy("i").collect()]
    assert column == [zipdocs.is_safe_name(n) for n in names] == [True, True, False, False, True, False, False, False, False, True, True]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../up/", "")
        z.writestr("a:b.md", b"# Caf\xe9\n\nbody")
        z.writestr("bad.md", "---\na: [\n---\nx")
        z.writestr("other.txt", "no")
    docs = zipdocs.structured_documents(zipdocs.scan_archives(spark, str(tmp_path)))
    assert {r["sourcePath"]: r["title"] for r in docs.collect()}["a:b.md"] == "Caf�"
    summary = zipdocs.ingestion_summary(zipdocs.archive_totals(spark, str(tmp_path)), docs).first().asDict()
    assert [f["sourcePath"] for f in summary.pop("failures")] == ["bad.md"]
    assert summary == {"totalEntries": 4, "matched": 2, "succeeded": 1, "failed": 1}
    records.write_documents(docs.select("documentId", "title"), str(tmp_path / "out"))
    assert records.read_json_documents(spark, str(tmp_path / "out"), "documentId string, title string", whole_files=False).count() == 2


def test_answers_out_of_order_and_late(spark):
    assert embedding.in_order([(1, [2.0]), (0, [1.0])]) == [[1.0], [2.0]] and embedding.in_order([[1.0], [2.0]]) == [[1.0], [2.0]] and embedding.in_order([]) == []
    with pytest.raises(ValueError):
        embedding.in_order([(0, [1.0]), (0, [2.0])])
    with pytest.raises(embedding.TransientProviderError):
        embedding.within(0.05, lambda: time.sleep(0.5))
    assert embedding.within(5, lambda: 3) == 3


def test_batch_search_matches_single_searches(spark):
    rng = random.Random(3)
    vectors = [[rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for _ in range(300)]
    points = spark.createDataFrame([(f"p{i:03d}", v) for i, v in enumerate(vectors)] + [("short", [1.0]), ("none", None), (None, vectors[0])], "id string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:9])], "queryId int, queryVector array<double>")
    for threshold in (None, 0.5):
        found = {}
        for r in retrieval.batch_top_k(points, queries, 7, threshold).orderBy("queryId", "rank").collect():
            found.setdefault(r["queryId"], []).append((r["id"], r["score"]))
        for i, q in enumerate(vectors[:9]):
            size = sum(x * x for x in q) ** 0.5
            scores = [(round(sum(x * y for x, y in zip(q, v)) / (size * sum(x * x for x in v) ** 0.5 or 1), 12) if size else 0.0, f"p{k:03d}") for k, v in enumerate(vectors)]
            expected = sorted(((-s, k) for s, k in scores if threshold is None or s >= threshold))[:7]
            assert [k for k, _ in found.get(i, [])] == [k for _, k in expected], (i, threshold)
            assert all(abs(a + b) < 1e-9 for (_, a), (b, _) in zip(found.get(i, []), expected))


def test_from_bodies_to_answers(spark, tmp_path):
    bodies = [(f"d{i}", f"docs/{i}.md", f"Guide {i}", f"# Guide {i}\n\nHow to start thing {i}.\n\n## Details\n\n" + f"word{i} " * 120) for i in range(6)]
    docs = spark.createDataFrame(bodies, "documentId string, sourcePath string, documentTitle string, body string")
    chunks = chunking.chunks(markdown.sections(docs)).join(docs.drop("body"), "documentId")
    inputs = embedding.with_embedding_ids(embedding.embedding_inputs(chunks.where("chunkType = 'child'")).where("input is not null"), "fake", "m", "1", 8)
    made = records.embedding_records(embedding.fake_embedded(inputs, 8), "fake", "m", "1", 8)
    records.append_records(made, str(tmp_path / "records"))
    stored = records.read_records(spark, str(tmp_path / "records"))
    assert records.existing_ids(spark, str(tmp_path / "records"), "fake", "m", "1", 8).count() == stored.count() == inputs.count()
    assert embedding.unembedded(inputs, stored).count() == 0
    status = indexing.index_status(stored, chunks, indexing.rejection("fake", "m", "1", 8, allow_fake=True))
    collections = store.Collections(spark, str(tmp_path / "store"))
    name = ids.collection_name("docs", "fake", "m", 8, "1")
    collections.ensure(name, 8)
    collections.upsert(name, indexing.points(status.where("status = 'indexed'"), "docs").withColumn("seq", F.lit(1)))
    points = collections.read(name)
    asked = [float(x) for x in points.where("sourcePath = 'docs/3.md'").orderBy("id").first()["vector"]]
    best = retrieval.top_k(points, asked, 3, retrieval.payload_filter(domain="docs", sourcePath="docs/3.md"))
    found = retrieval.results(best).select(F.lit(1).alias("queryId"), "*", F.lit(0).alias("position"))
    answer = answering.ask(spark.createDataFrame([(1, "how?")], "queryId long, question string"), found).first()
    assert answer["reason"] is None and answer["cited"] == ["S1"]
    cited = answering.citations(spark.createDataFrame([(1, "[S1]")], "queryId long, answer string"), answering.select_context(found)).first()
    assert (cited["title"], cited["source"]) == ("Guide 3", "docs/3.md")
