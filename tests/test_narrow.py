"""The narrow pass against the joins and windows of ``chunking``, rebuilt by hand, and with documents that break the parser."""

import hashlib
import random

import pytest
from ragloom.operators import chunking, markdown, narrow
from ragloom.plans import catalog

FIELDS = [f.split()[0] for f in narrow.CHUNKS.split(", ") if not f.startswith("error")]


def body(rng):
    out = [rng.choice(["", "before. "])]
    for _ in range(rng.randrange(9)):
        out.append("#" * rng.randint(1, 4) + f" {rng.choice(['One', 'Two', 'Zürich', 'One'])}")
        for _ in range(rng.randrange(4)):
            kind = rng.randrange(6)
            words = " ".join(rng.choice(["alpha", "beta.", "gamma!", "\U0001f600"]) for _ in range(rng.choice([2, 9, 60])))
            if kind < 3:
                out.append(words)
            elif kind == 3:
                out.append("\n".join(f"- item {i} {words[:40]}" for i in range(rng.randrange(1, 12))))
            elif kind == 4:
                out.append("| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {words[:20]} |" for i in range(rng.randrange(1, 12))))
            else:
                out.append("```py\n" + words + "\n```" if rng.random() < 0.5 else "> **Note** " + words)
    return "\n\n".join(out)


def rows_of(df):
    return sorted((tuple(str(r[f]) for f in FIELDS) for r in df.select(*FIELDS).collect()), key=lambda r: (r[1], r[2], int(r[7]), r[0]))


@pytest.mark.parametrize("settings", [{}, {"most": 60, "least": 30, "overlap": "sentence-overlap", "overlap_sentences": 2}, {"most": 200, "least": 80, "strategy": "char", "overlap": "none", "include_parents": False}, {"most": 40, "least": 20, "strategy": "word"}])
def test_chunks_are_those_of_the_joins(spark, settings):
    rng = random.Random(len(str(settings)))
    docs = [(f"d{i:02d}", body(rng)) for i in range(40)] + [("none", None), ("blank", " \n"), ("plain", "no heading")]
    df = spark.createDataFrame(docs, "documentId string, body string")
    expected = rows_of(chunking.chunks(markdown.sections(df), **settings))
    spark.catalog.clearCache()
    found = narrow.document_chunks(df, **settings)
    assert found.where("error is not null").count() == 0
    assert rows_of(found) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "InMemory" not in plan


def test_golden_document(spark):
    text = "# Guide\n\nIntro line.\n\n## Install\n\nRun it.\n\n## Use\n\n" + "word " * 30 + "\n\n" + "more " * 30
    rows = {(r["chunkType"], r["sequenceIndex"], r["headingPath"][-1]["text"]): r for r in narrow.document_chunks(spark.createDataFrame([("doc", text)], "documentId string, body string"), most=45, least=10).collect()}
    sha = lambda *p: hashlib.sha256("::".join(map(str, p)).encode()).hexdigest()
    guide, use = rows["parent", -1, "Guide"], rows["parent", -1, "Use"]
    assert guide["chunkId"] == sha("doc", "parent", "guide", 0, 0) and guide["text"] == text.replace("word " * 30, ("word " * 30).strip()).strip() or guide["text"].startswith("# Guide\n\nIntro line.\n\n## Install\n\nRun it.\n\n## Use")
    first, second = rows["child", 2, "Use"], rows["child", 3, "Use"]
    assert first["chunkId"] == sha("doc", "child", "guide/use", 0, 0) and second["chunkId"] == sha("doc", "child", "guide/use", 0, 1)
    assert second["text"].startswith('_(continued from "Guide › Use")_\n\n## Use\n\nmore') and second["contentHash"] == sha("## Use\n\n" + ("more " * 30).strip())
    assert use["childChunkIds"] == [first["chunkId"], second["chunkId"]] and first["parentChunkId"] == use["chunkId"]
    assert (first["previousChunkId"], first["nextChunkId"], second["nextChunkId"]) == (rows["child", 1, "Install"]["chunkId"], second["chunkId"], None)


def test_one_broken_document_is_one_failed_row(spark, monkeypatch):
    deep = ">" * 3000 + " x"
    df = spark.createDataFrame([("a", "# A\n\ntext"), ("deep", "# D\n\n" + deep), ("bad", "# B\n\nBOOM"), ("a", "# A\n\nother")], "documentId string, body string")
    assert {r["outlineError"] for r in markdown.outlines(df).collect()} == {None}

    def measure(text):
        if "BOOM" in text:
            raise ValueError("poison")
        return len(text)

    rows = narrow.document_chunks(df, strategy=measure).collect()
    assert [(r["documentId"], r["error"]) for r in rows if r["error"]] == [("bad", "ValueError: poison")]
    assert {r["documentId"] for r in rows if r["chunkId"]} == {"a", "deep"} and sum(r["documentId"] == "a" for r in rows) == 4


def test_kept_columns_and_unknown_settings(spark):
    df = spark.createDataFrame([("a", "# A\n\ntext", "T", 5), ("b", None, "U", 6)], "documentId string, body string, title string, n int")
    assert {(r["title"], r["n"]) for r in narrow.document_chunks(df, keep=("title", "n")).collect()} == {("T", 5)}
    with pytest.raises(ValueError):
        narrow.document_chunks(df, strategy="bytes")
    with pytest.raises(ValueError):
        narrow.document_chunks(df, overlap="all")


@pytest.mark.parametrize("settings", [{}, {"most": 60, "least": 30}, {"most": 40, "least": 20, "strategy": "word"}])
def test_statistics_are_those_of_the_joins_without_a_shuffle(spark, settings):
    rng = random.Random(5)
    docs = [(f"d{i:02d}", body(rng)) for i in range(40)] + [("none", None), ("blank", " \n"), ("plain", "no heading")]
    df = spark.createDataFrame(docs, "documentId string, body string")
    sections = markdown.sections(df)
    names = ["documentId", "sections", "pieces", "splitSections", "mergedSections"]
    expected = {tuple(r) for r in chunking.chunk_statistics(sections, chunking.ordered_pieces(sections, **settings)).select(*names).collect()}
    spark.catalog.clearCache()
    found = narrow.document_statistics(df, **settings)
    assert {tuple(r) for r in found.where("error is null").select(*names).collect()} == expected and found.count() == len(expected)
    plan = catalog.QUERIES["chunk_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "InMemoryTableScan" not in plan


#: Lines that are blank, end or begin with space, or look like Markdown or marks, alone, within and at the end.
PLAIN = ["", "\n", "one\n", "one\n\n\ntwo\n", " \n\t", "  lead\ntrail  ", "# h\n- a\n    code\n---\n```\n> q\n===\n| a |\n|---|\n[r]: u\n1. x\n~~~", "\x01\n\x01\x01", "word " * 900 + "\n\n" + "word. " * 900 + "\n", "a\nb\nc\n"]


@pytest.fixture(scope="module")
def odd_lines(tmp_path_factory):
    import duckdb

    folder = tmp_path_factory.mktemp("odd")
    connection = duckdb.connect()
    connection.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    connection.executemany("insert into documents values (?, ?, 'en', 'src')", list(enumerate([*PLAIN, None])))
    connection.execute(f"copy documents to '{folder}/documents.parquet' (format parquet)")
    return folder, connection


def same_as_sql(spark, odd_lines, name):
    folder, connection = odd_lines
    df = catalog.QUERIES[name](spark, str(folder))
    found = connection.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    plain = lambda rows: sorted(repr([str(x) for x in r]) for r in rows)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())


@pytest.mark.parametrize("name", ["chunk_documents", "parent_text", "section_stats", "chunk_stats"])
def test_lines_of_plain_text_are_paragraphs_as_in_sql(spark, odd_lines, name):
    same_as_sql(spark, odd_lines, name)


@pytest.mark.parametrize("name", ["list_chunks", "table_chunks"])
def test_items_and_rows_of_blank_lines_are_whole_as_in_sql(spark, odd_lines, name):
    same_as_sql(spark, odd_lines, name)


def test_unmarked_takes_one_mark_from_each_end_of_a_line():
    assert [markdown.unmarked(t) for t in ("", "\x01\x01", "# h\n\n\x01a \x01\n\n\x01\x01\n\x01b\x01", "\x01\x01x\x01\x01", "a\x01b", "- 0 \x01")] == ["", "", "# h\n\na \n\n\nb", "\x01x\x01", "a\x01b", "- 0 "]
