"""Language identification: subwords against a plain reading, rejection of what was not learnt, the bounds of the sample."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from ragloom.llm import langid


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def plain_subwords(text):
    """Number of subwords by their letters: runs of one to four code points, gaps at the edges only and never alone."""
    text = "".join(" " if ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 191 else c for c in f" {text.lower()} ")
    out = []
    for n in range(1, 5):
        for i in range(len(text) - n + 1):
            s = text[i : i + n]
            if s.strip() and " " not in s[1:-1]:
                out.append(s)
    return Counter(Counter(out).values()), len(out)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 18])
def test_subwords_are_those_of_a_plain_reading(monkeypatch, chunk):
    monkeypatch.setattr(langid, "_CHUNK", chunk)
    rng = random.Random(1)
    for text in ["a", "", "  ", "ab-cd e", "Ünï çødé \U0001f600 x", "İstanbul", prose(rng, 40), "x" * 90]:
        found = np.concatenate(list(langid.subwords(text)))
        times, n = plain_subwords(text)
        assert len(found) == n and Counter(np.unique(found, return_counts=True)[1].tolist()) == times, text


def test_unknown_languages_and_letter_junk_are_rejected():
    rng = random.Random(2)
    make = {name: lambda n, letters=letters, tails=tails: " ".join(w + rng.choice(tails) for w in prose(rng, n, letters).split()) for name, letters, tails in (("a", "abcde", ["ab", "cade"]), ("b", "bcdef", ["fe", "bed"]), ("c", "vwxyz", ["wy", "zx"]))}
    texts = [(make[name](rng.randint(5, 90)), name) for name in "ab" for _ in range(150)]
    model = langid.train([t for t, _ in texts], [name for _, name in texts])
    own = [langid.predict(model, make[name](rng.randint(5, 90))) for name in "ab" for _ in range(100)]
    assert np.mean([r for _, _, r in own]) < 0.03
    assert np.mean([langid.predict(model, make["c"](rng.randint(5, 90)))[2] for _ in range(60)]) > 0.97
    assert langid.predict(model, "123 .") == ("und", 0.0, True) and langid.predict(model, None) == ("und", 0.0, True)


def test_every_word_of_a_training_text_is_read():
    text = prose(random.Random(3), 500)
    assert " ".join(langid._stretches(text, np.random.default_rng(0))) == text


def test_the_sample_is_bounded_in_rows_and_takes_long_texts(spark):
    rng = random.Random(4)
    rows = [(1, "repeated text", "l1", "old")] * 400 + [(i, prose(rng, 30), f"l{i % 7}", "old") for i in range(200)] + [(None, "nobody", "l1", "old"), (500, None, "l1", "old"), (501, "word " * 20_000, "long", "old"), (502, "x", None, "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    sample = langid.training_sample(docs, 20)
    assert max(Counter(r["lang"] for r in sample).values()) <= 20 and {"l0", "l6"} <= {r["lang"] for r in sample}
    assert None not in {r["doc_id"] for r in sample} and ("long" in {r["lang"] for r in sample}) == (zlib.crc32(b"501") % 5 != 0)
    few = Counter(r["lang"] for r in langid.training_sample(docs, 20, rows=10, least=2))
    assert set(few) == {r["lang"] for r in sample} and max(few.values()) <= 2  # every language, however tight the bound
    got = langid.language_report(docs).collect()
    assert len(got) == len(rows) and all(r["held_out"] is not None for r in got)
