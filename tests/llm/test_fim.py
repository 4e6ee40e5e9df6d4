"""Elias-Fano lists against plain offsets, and the cuts against a plain reading and the query's SQL."""

import hashlib
import random
import re

import pytest

from ragloom.llm import common, fim, queries


def made(rng, n):
    return "".join(rng.choice("aé日😀 ") for _ in range(n))


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_lists_give_every_boundary(monkeypatch, block):
    monkeypatch.setattr(fim, "_BLOCK", block)
    rng = random.Random(1)
    for text in ["", "a", "é", "日本語" * 200, "ab" * 700, "é" * 3000, *[made(rng, n) for n in (255, 256, 257, 1500)]]:
        blob, at = fim.encode(text.encode()), 0
        assert fim.units_of(blob) == len(text)
        for k in range(len(text) + 1):
            assert fim.select(blob, k) == at
            at += len(text[k : k + 1].encode())


def test_lists_of_other_units():
    pattern = re.compile(r"\S+\s*")
    for text in ["", "  one twoé  three", "一 二" * 300, "x" * 900]:
        blob = fim.encode(text.encode(), pattern)
        starts = [m.start() for m in pattern.finditer(text)]
        want = [0, *[len(text[:s].encode()) for s in starts[1:]], len(text.encode())] if starts else [len(text.encode())]
        assert [fim.select(blob, k) for k in range(fim.units_of(blob) + 1)] == want


def test_lists_are_small():
    # two bits a boundary and as many as the logarithm of its share of the bytes, and a sample of eight bytes for 256 boundaries
    for text, log in (("a", 0), ("日", 2)):
        assert len(fim.encode(text.encode() * 80_000)) <= 80_001 * (2 + log) / 8 + 8 * 80_001 / 256 + 32


def plain(doc_id, text, seed=1):
    text = text or ""
    n, digest = len(text), lambda t: hashlib.sha256(t.encode()).hexdigest()
    h = [int(digest(f"{seed}:{doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, digest(text), digest(text)
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, a, b - a, digest(out), digest(text)


def rows():
    rng = random.Random(2)
    out = [(i, made(rng, rng.randrange(80))) for i in range(150)]
    out += [(i, "one text of many, <S" if i % 3 else "<S>" * 9) for i in range(200, 320)]
    return out + [(400, None), (401, ""), (None, "no id"), (402, "long " * 40_000), (5, out[5][1]), (403, "<<P> x"), (404, "<S")]


@pytest.mark.parametrize("share", [1000, 4])
def test_every_cut(spark, monkeypatch, share):
    monkeypatch.setattr(fim, "HEAVY_SHARE", share)  # 4: the repeated texts are heavy and dealt by a salt
    df = spark.createDataFrame([(*r, 7, "x") for r in rows()], "doc_id long, text string, n int, key string")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, fim.transformed(df).collect()), key=key) == sorted((plain(*r) for r in rows()), key=key)
    assert fim.transformed(df.limit(0)).count() == 0
    assert common.HEAVY_SHARE == 1000


def test_shares_seed_and_units(spark):
    df = spark.createDataFrame([(i, "one two three four") for i in range(300)], "doc_id long, text string")
    forms = fim.fill_in_middle(df, seed=3, plain_percent=50, spm_percent=0, pattern=r"\S+\s*").toPandas()
    assert set(forms["form"]) == {"plain", "psm"} and 90 < (forms["form"] == "plain").sum() < 210
    assert set(forms["n"]) == {4} and forms["middle_units"].max() <= 4
    pieces = {p for o in forms.loc[forms["form"] == "psm", "output"] for p in re.split("<.>", o)[1:]}
    assert all(p in "one two three four" and not re.search(r"\S$", p) or p.endswith("four") or not p for p in pieces)


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame([(i, f"text {i % 50}") for i in range(300)], "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fim.transformed(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 2  # the texts, and (doc_id, key)


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([r for r in rows() if r[0] is not None], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_fill_in_middle(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = duck.execute(fim.ORACLE_SQL)
    assert [c[0] for c in expected.description] == found.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected.fetchall(), key=key)
