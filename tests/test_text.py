import random

from pyspark.sql import functions as F

from ragloom.functions import folds, generation, ids, text, vectors


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("out")).first()["out"]


def test_lengths_count_utf16_units_and_unicode_spaces(spark):
    t = "café x \U0001f600"
    assert one(spark, text.utf16_length(F.col("t")), t=t) == 9
    assert one(spark, text.word_count(F.col("t")), t=t) == 3
    assert one(spark, text.token_estimate(F.col("t")), t=t) == 3


def test_truncation_keeps_whole_words(spark):
    words = " ".join(f"word{i}" for i in range(50))
    cut = one(spark, text.truncate_words(F.col("t"), 10), t=words)
    assert cut["truncated"] and words.startswith(cut["text"]) and words[len(cut["text"])] == " " and len(cut["text"]) <= 40
    assert one(spark, text.truncate_words(F.col("t"), 1), t="unbroken" * 5)["text"] == "unbroken" * 5
    assert one(spark, text.truncate_words(F.col("t"), 1), t="unbroken rest")["text"] == "unbroken"


def test_globs(spark):
    cases = [("**/*.md", "a/b/c.md", True), ("**/*.md", "c.md", True), ("*.md", "a/c.md", False), ("a/?.md", "a/b.md", True), ("a/**/b", "a/xb", True), ("a.b", "axb", False), ("**", "a\n", True)]
    for pattern, path, expected in cases:
        assert one(spark, text.matches_glob(F.col("p"), pattern), p=path) is expected, (pattern, path)


def test_entry_names(spark):
    for name, safe in {"a/b.md": True, "a/../b": True, "../b": False, "/a": False, "a/../../b": False, "\\a": False, "a\\..\\..\\b": False, "./a": True}.items():
        assert one(spark, text.is_safe_entry(F.col("n")), n=name) is safe, name


def test_point_id_shape(spark):
    import hashlib

    e = hashlib.sha256(b"x").hexdigest()
    h = bytearray(hashlib.sha1((ids.POINT_NAMESPACE + e).encode()).digest()[:16])
    h[6], h[8] = h[6] & 15 | 0x50, h[8] & 0x3F | 0x80
    x = h.hex()
    assert one(spark, ids.point_id(F.col("e")), e=e) == f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"
    assert ids.collection_name("Docs", "p", "m-1", 8, "1.0") == "docs__p_m_1_8d_v1_0"


def test_zero_norm_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] == 0


def test_cost_and_failures(spark):
    df = spark.createDataFrame([(970, 218)], "i long, o long")
    assert abs(df.select(generation.cost_usd(F.col("i"), F.col("o"))).first()[0] - 0.001545) < 1e-12
    rows = spark.createDataFrame([("transient", "timed out", False), ("transient", "boom", False), ("permanent", "", True), ("rate-limit", "", False), ("permanent", "", False)], "k string, m string, a boolean")
    assert [r[0] for r in rows.select(generation.failure_class(F.col("k"), F.col("m"), F.col("a"))).collect()] == ["timeout", "provider", "authentication", "quota", "internal"]
    delays = spark.createDataFrame([("2",), ("-1",), ("Wed, 21 Oct 2015",), (None,)], "h string")
    assert [r[0] for r in delays.select(generation.retry_after_ms(F.col("h"))).collect()] == [2000.0, None, None, None]


def test_folds_match_loops(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, x array<int>")
    got = {r["k"]: (r["a"], r["b"]) for r in df.select("k", folds.greedy_bins(F.col("x"), 20, 3, 4).alias("a"), folds.sibling_groups(F.transform("x", lambda v: F.struct((v < 8).alias("eligible"), v.alias("length"))), 20).alias("b")).collect()}
    for k, x in rows:
        bins, number, size, n = [], 0, 3, 0
        for v in x:
            if n and (size + v > 20 or n >= 4):
                number, size, n = number + 1, 3, 0
            bins.append(number)
            size, n = size + v, n + 1
        groups, group, pending = [], -1, None
        for v in x:
            if v < 8 and pending is not None and pending + v <= 20:
                pending += v
            else:
                group, pending = group + 1, v if v < 8 else None
            groups.append(group)
        assert got[k] == (bins, groups)
