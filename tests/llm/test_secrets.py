"""Secret scans: entropy of both classes by brute force, and texts of very many matches."""

import random
import re

import numpy as np
import pytest
from ragloom.llm import secrets


def report(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(texts)], "doc_id long, text string, spans string, base_spans string")
    return {r["doc_id"]: r for r in secrets.secret_report(docs).collect()}


def allowed(value):
    return bool(re.search(secrets.ALLOW.replace("|(?i)", "|(?i:") + ")", value))


def random_window(value, kind):
    _, _, width, bits = secrets.CLASSES[kind]
    windows = [value[i : i + width] for i in range(len(value) - width + 1)]
    return any(-sum(w.count(c) / width * np.log2(w.count(c) / width) for c in set(w)) >= bits - 1e-9 for w in windows)


def brute(text):
    base = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    outside = lambda m, spans: not any(a <= m.start() and m.end() <= b for a, b in spans)
    found = {}
    for kind, (_, pattern, _, _) in secrets.CLASSES.items():
        found[kind] = [(m.start(), m.end()) for m in re.finditer(pattern, text) if not allowed(m[0]) and outside(m, base) and random_window(m[0], kind)]
    narrow = found["entropy_hex"]
    found["entropy_base64"] = [s for s in found["entropy_base64"] if not any(a <= s[0] and s[1] <= b for a, b in narrow)]
    return {f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans}


@pytest.mark.parametrize("block", [2, 64])
def test_entropy_spans_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(secrets, "_BLOCK", block)
    rng = random.Random(1)
    alphabets = ["0123456789abcdefABCDEF", "0123456789ABCDEF", "0a", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789", "abc1"]
    word = lambda: "".join(rng.choice(a) for a in [rng.choice(alphabets)] for _ in range(rng.randint(10, 45)))
    texts = [rng.choice([" ", "\n", ": ", " é\U0001f600 "]).join(word() for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = report(spark, [*texts, None, ""])
    for i, text in enumerate(texts):
        assert {s for s in rows[i]["spans"].split(",") if s.startswith("entropy")} == brute(text), text
    assert any("entropy_hex" in rows[i]["spans"] for i in range(80)) and any("entropy_base64" in rows[i]["spans"] for i in range(80))


def redact(text, spans, mark="[SECRET]"):
    out, at = "", 0
    for a, b in sorted(spans):
        if b > at:
            out += (text[at:a] + mark) if a >= at else ""
            at = b
    return out + text[at:]


@pytest.mark.parametrize("block", [3, 64])
def test_redaction_matches_a_plain_cut(spark, monkeypatch, block):
    monkeypatch.setattr(secrets, "_BLOCK", block)
    rng = random.Random(2)
    atoms = ["password=", "token: ", "AKIA" + "A7" * 10, "0123456789abcdef" * 2, "plain", "é ", "\U0001f600", "deadbeef99", " ", "abcDEF123+/zzTT99qq"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["", None, "no secret"]
    rows = report(spark, texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, secret_spans string")
    for r in secrets.redacted(docs.drop("secret_spans")).collect():
        i = r["doc_id"]
        spans = [tuple(map(int, s.rsplit(":", 2)[1:])) for s in rows[i]["spans"].split(",") if s]
        assert r["text"] == (None if texts[i] is None else redact(texts[i], spans)), texts[i]


def test_very_many_matches(spark):
    keys = " ".join(f"key{i} password=abcdef{i:06d} {'0a1b2c3d' * 3}{i:04x}" for i in range(6000))
    row = report(spark, [keys])[0]
    assert (row["n_assign"], row["n_hex"]) == (6000, 6000) and len(row["spans"].split(",")) == 12000
    clean = secrets.redacted(spark.createDataFrame([(0, keys)], "doc_id long, text string")).first()["text"]
    assert clean == " ".join(f"key{i} [SECRET] [SECRET]" for i in range(6000))
