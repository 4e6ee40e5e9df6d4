"""Runs against a search of every period, and the query against its SQL and a plain reading."""

import hashlib
import random
import re
import zlib

from ragloom.llm import queries, runs


def plain_runs(w, least=6, power=4):
    out = []
    for p in range(1, len(w) // power + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i - start + p
            shorter = any(all(w[k] == w[k + q] for k in range(start, start + length - q)) for q in range(1, p))
            if length >= max(least, power * p) and not shorter:
                out.append((start, length, p))
    return sorted(out)


def made(rng, most=60):
    letters, n = rng.choice([1, 2, 2, 3, 4, 6]), rng.randrange(most)
    w = [rng.randrange(letters) for _ in range(n)]
    if n > 8 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3) + 1)
        for i in range(a, n):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_are_those_of_a_search_of_every_period():
    rng = random.Random(5)
    for _ in range(800):
        w = made(rng)
        assert runs.find_runs(w) == plain_runs(w), w
        assert runs.find_runs(w, 2, 2) == plain_runs(w, 2, 2), w
    for _ in range(5):
        w = made(rng, 300)
        assert runs.find_runs(w, 2, 2) == plain_runs(w, 2, 2)


def test_extensions_do_not_depend_on_the_hash(monkeypatch):
    monkeypatch.setattr(runs, "_PRIME", 3)  # nearly all stretches share a hash
    rng = random.Random(6)
    for _ in range(60):
        w = made(rng, 200)
        assert runs.find_runs(w, 2, 2) == plain_runs(w, 2, 2), w


def test_long_periodic_texts_take_time_in_proportion():
    fibonacci, last = [0], [0, 1]
    while len(last) < 100_000:
        fibonacci, last = last, last + fibonacci
    assert runs.find_runs(last) == []
    assert runs.find_runs([0] * 100_000) == [(0, 100_000, 1)]
    assert runs.find_runs([i % 1000 for i in range(100_000)]) == [(0, 100_000, 1000)]


def test_words_are_read_part_by_part(monkeypatch):
    text = " a\tbb\x0bccc d \x1c e\n" * 50
    whole = runs.read_words(text)
    monkeypatch.setattr(runs, "_PART", 7)
    assert runs.read_words(text) == whole
    assert len(whole[0]) == len(re.findall(runs.WORD, text))


def plain_row(doc_id, text):
    words = re.findall(runs.WORD, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p if i >= a else i] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listing = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, digest(listing), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_on_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{x}" for x in made(rng, 90))) for i in range(60)]
    rows += [(None, "a a a a a a a"), (3, rows[3][1]), (100, None), (101, ""), (102, " \n\t "), (103, "ab " * 5000), (104, "x y " * 3 + "é  \x1c " * 9)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, collapsed string")
    key = lambda r: (str(r[0]), *map(str, r))
    assert sorted(map(tuple, runs.periodic_runs(df).collect()), key=key) == sorted((plain_row(*r) for r in rows), key=key)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in made(rng, 90))) for i in range(120)] + [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = duck.execute(runs.ORACLE_SQL)
    names = [c[0] for c in expected.description]
    assert names == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
