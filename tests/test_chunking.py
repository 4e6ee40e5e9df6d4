import random

from ragloom.operators import chunking, markdown


def chunked(spark, body, **settings):
    df = spark.createDataFrame([("d", body)], "documentId string, body string")
    rows = chunking.chunks(markdown.sections(df), **settings).collect()
    spark.catalog.clearCache()
    return sorted((r for r in rows if r["chunkType"] == "child"), key=lambda r: r["sequenceIndex"]), [r for r in rows if r["chunkType"] == "parent"]


def test_blocks():
    body = "# A\n\ntext\nmore\n\n```py\nx = 1\n# no heading\n```\n\n- one\n  - two\n- three\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> **Note** be careful\n\nTitle\n-----\n\n---\n\n    indented\n\n[ref]: http://x\n"
    sections = markdown.section_tree(body)
    assert [(s["level"], s["text"], s["parent"]) for s in sections] == [(0, "", -1), (1, "A", 0), (2, "Title", 1)]
    assert [b["type"] for b in sections[1]["blocks"]] == ["paragraph", "code", "list", "table", "note"]
    assert sections[1]["blocks"][2]["items"] == ["- one\n  - two", "- three\n"]
    assert sections[1]["blocks"][3]["rows"] == ["| 1 | 2 |"]
    assert [b["type"] for b in sections[2]["blocks"]] == ["code"]


def test_outline_reads_nested_blocks():
    found = markdown.outline("# T\n\n> ## Q\n>\n> [l](http://q)\n\n- item\n\n  ~~~sh\n  ls\n  ~~~\n")
    assert [(h["text"], h["parentIdx"]) for h in found["headings"]] == [("T", -1), ("Q", 0)]
    assert found["codeBlocks"] == [{"language": "sh", "content": "ls\n", "position": 0}] and found["links"] == ["http://q"] and found["first_h1"] == "T"


def test_small_siblings_merge_within_the_limit(spark):
    body = "# R\n\n" + "\n\n".join(f"## {c}\n\n{c * 8}" for c in "abc")
    children, parents = chunked(spark, body, most=30, least=20, strategy="char")
    assert [c["mergedHeadings"] for c in children if c["wasMerged"]] == [["b"]]
    assert [c["length"] for c in children] == [3, 24, 12]
    assert len(parents) == 4 and all(p["sequenceIndex"] == -1 for p in parents)
    assert children[0]["nextChunkId"] == children[1]["chunkId"] and children[2]["previousChunkId"] == children[1]["chunkId"]


def test_split_keeps_table_header_and_continues(spark):
    rows = "\n".join(f"| {i} | value |" for i in range(30))
    children, _ = chunked(spark, f"# T\n\n| a | b |\n|---|---|\n{rows}", most=40, least=1)
    assert len(children) > 2 and all("| a | b |" in c["text"] for c in children) and all(c["wasSplit"] for c in children)
    assert children[1]["text"].startswith('_(continued from "T")_\n\n# T')


def test_sentence_overlap(spark):
    body = "# T\n\nFirst one. Second one.\n\nThird one. Fourth one."
    children, _ = chunked(spark, body, most=30, least=1, strategy="char", overlap="sentence-overlap")
    assert children[1]["text"].startswith("Second one.\n\n# T")


def test_text_before_the_first_heading_and_empty_bodies_give_nothing(spark):
    df = spark.createDataFrame([("a", "just text"), ("b", None), ("c", "  \n")], "documentId string, body string")
    assert chunking.chunks(markdown.sections(df)).count() == 0


def test_same_headings_get_different_ids(spark):
    children, parents = chunked(spark, "# A\n\n## X\n\n" + "w " * 300 + "\n\n## X\n\n" + "v " * 300, most=500, least=1)
    assert len({c["chunkId"] for c in [*children, *parents]}) == len(children) + len(parents)


def test_order_is_that_of_the_recursion(spark):
    rng = random.Random(5)
    for _ in range(3):
        parts, level = [], 1
        for i in range(14):
            level = 1 if i == 0 else rng.randint(2, min(level + 1, 4))
            parts.append("#" * level + f" h{i}\n\n" + "x" * rng.choice([3, 60]))
        body = "\n\n".join(parts)
        sections = markdown.section_tree(body)

        def size(s):
            return len("#" * s["level"] + " " + s["text"]) + sum(len(b["text"]) for b in s["blocks"])

        def walk(parent):
            out, run = [], []
            own = [s for s in sections if s["parent"] == parent]
            groups = []
            for s in own:
                if size(s) < 40 and run and sum(map(size, run)) + size(s) <= 70:
                    run.append(s)
                elif size(s) < 40:
                    run = [s]
                    groups.append(run)
                else:
                    run = []
                    groups.append([s])
            for g in groups:
                out.append(g[0]["text"])
                for s in g:
                    out += walk(s["idx"])
            return out

        children, _ = chunked(spark, body, most=70, least=40, strategy="char")
        assert [c["headingPath"][-1]["text"] for c in children if c["localSequenceIndex"] == 0] == walk(0)
