"""Near-duplicate removal by rows, and its recall."""

import random

import numpy as np
import pytest
from ragloom.llm import neardup


def prose(rng, n, vocabulary):
    return rng.choices(vocabulary, k=n)


def similarity(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a, b))
    return len(a & b) / len(a | b)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    base = [prose(rng, 150, vocabulary) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    rows = [(i, texts[i], "k") for i in range(40)]
    rows += [(5, texts[5], "k")] * 3 + [(None, texts[6], "k"), (None, "lone " + " ".join(prose(rng, 90, vocabulary)), "k")] + [(None, "nameless " * 3 + " ".join(base[0][:0] + prose(random.Random(9), 80, vocabulary)), "k")] * 2
    rows += [(7, " ".join(prose(rng, 100, vocabulary)), "k"), (60, None, "k"), (61, "", "k"), (62, " ", "k"), (50, texts[3].upper(), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = neardup.deduplicated(docs)
    got = sorted(map(tuple, kept.collect()), key=str)
    assert kept.columns == docs.columns
    expected = [(i, texts[i], "k") for i in range(40)] + [rows[44], rows[45], (7, rows[47][1], "k")]
    assert [r for r in got if r[0] != 60 and r[0] not in (61, 62)] == sorted(expected, key=str)
    assert sum(r[0] in (60, 61, 62) for r in got) == 1
    assert neardup.deduplicated(docs.limit(0)).count() == 0


def test_recall_of_near_copies_and_no_loss_of_others(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    rows, near = [], 0
    for i in range(200):
        words = prose(rng, rng.randint(60, 400), vocabulary)
        copy = list(words)
        for at in rng.sample(range(len(copy)), max(1, len(copy) // 90)):
            copy[at] = rng.choice(vocabulary)
        rows += [(2 * i, " ".join(words))]
        if i < 120 and similarity(words, copy) >= 0.8:
            rows += [(2 * i + 1, " ".join(copy))]
            near += 1
    kept = {r["doc_id"] for r in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near > 90 and {2 * i for i in range(200)} <= kept
    assert len(kept) - 200 <= 0.1 * near


def near_groups(rows, least=0.8):
    """Rows by the components of all pairs with exactly this similarity or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                head[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("comparisons", [256, 1])
def test_shared_openings_and_repeated_words_are_no_copies(spark, monkeypatch, comparisons):
    monkeypatch.setattr(neardup, "BUCKET_COMPARISONS", comparisons)  # 1: everything goes through tiles
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    opening = " ".join(prose(rng, 40, vocabulary))
    rows = [(i, opening + " " + " ".join(prose(rng, 25, vocabulary))) for i in range(40)]  # boilerplate
    rows += [(100 + i, " ".join(sorted(prose(random.Random(5), 60, vocabulary), key=lambda w: rng.random()))) for i in range(20)]  # the same words in another order
    rows += [(200 + i, "ha " * (5 + i) + " ".join(prose(rng, 6, vocabulary))) for i in range(20)]
    for i in range(30):
        words = prose(rng, 150, vocabulary)
        rows.append((300 + 10 * i, " ".join(words)))
        for k in range(rng.randrange(3)):
            copy = list(words)
            copy[rng.randrange(150)] = "edited"
            rows.append((301 + 10 * i + k, " ".join(copy)))
    kept = {r["doc_id"] for r in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = near_groups(rows)
    assert kept == {rows[g][0] for g in set(groups)}


def test_sketches_estimate_the_similarity():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    for _ in range(20):
        a = prose(rng, 300, vocabulary)
        b = [w if rng.random() < 0.97 else "x" for w in a]
        x, y = (np.frombuffer(neardup.signature(" ".join(t))[1], np.uint8) for t in (a, b))
        assert abs((x == y).mean() - similarity(a, b)) < 0.13
    assert neardup.signature(None) == neardup.signature(" \n") == (0, bytes(neardup.MINIMA)) and neardup.signature("one two")[1] != neardup.signature("two one")[1]


def test_only_rows_with_a_close_fingerprint_are_given_sketches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 100)  # 7 tiles a side
    rng = random.Random(8)
    near = rng.getrandbits(62)
    fps = {i: rng.getrandbits(62) for i in range(600)} | {600: near, 601: near ^ 0b111, 602: near, 603: near ^ 0b1111110000}
    spark.createDataFrame([(0, 5, fp, n) for n, fp in fps.items() if n != 602] + [(0, 7, near, 602)], "part int, key long, fp long, node long").write.parquet(str(tmp_path / "k"))
    pairs = spark.createDataFrame([(0, 5, 5, 603, 603), (0, 5, 7, 603, 1)], "part int, key long, near long, n long, n_near long")
    rows = neardup.close_tiles(spark.read.parquet(str(tmp_path / "k")), pairs, 6).collect()
    # Of 600 far rows none is left; a row is never its own neighbour; equal fingerprints of different nodes are close.
    assert {(r["near"], r["node"]) for r in rows} == {(5, 600), (5, 601), (5, 603), (7, 600), (7, 601), (7, 602), (7, 603)}
    assert len(rows) < 40
