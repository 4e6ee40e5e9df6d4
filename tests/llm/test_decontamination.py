"""Decontamination against brute force on small tables, and its recall of paraphrases."""

import random
import re

import numpy as np
from ragloom.llm import decontamination


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def paraphrase(rng, item, vocabulary):
    """Words replaced, left out, put in and swapped with neighbours; the answer (the last sentence) nearly kept."""
    sentences = [s.split() for s in item.split(". ")]
    out = []
    for k, words in enumerate(sentences):
        few = 0.05 if k == len(sentences) - 1 else 0.12
        changed = []
        for w in words:
            x = rng.random()
            changed += [rng.choice(vocabulary)] if x < few else [] if x < 1.5 * few else [w, rng.choice(vocabulary)] if x < 2 * few else [w]
        if len(changed) > 3:
            i = rng.randrange(len(changed) - 1)
            changed[i], changed[i + 1] = changed[i + 1], changed[i]
        out.append(" ".join(changed))
    return ". ".join(out)


def test_recall_of_paraphrases_and_no_false_alarm(spark):
    rng = random.Random(7)
    vocabulary = prose(rng, 900).split()
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [". ".join([text(rng.randint(12, 60)), text(rng.randint(8, 30)), text(rng.randint(6, 15))]) for _ in range(100)]
    held = [text(rng.randint(0, 200)) + " " + paraphrase(rng, item, vocabulary) + " " + text(rng.randint(0, 200)) for item in items]
    clean = [text(rng.randint(20, 500)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(held + clean)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert len(found & {(i, i) for i in range(100)}) >= 90
    assert not found - {(i, i) for i in range(100)}


def best_overlap(item, words):
    """Greatest common subsequence with any stretch of words somewhat longer than the item, by the plain table."""
    best = 0
    for at in range(max(1, len(words) - len(item) + 1)):
        span = words[at : at + len(item) + 2]
        row = [0] * (len(span) + 1)
        for x in item:
            row = _next(row, x, span)
        best = max(best, row[-1])
    return best / len(item)


def _next(row, x, span):
    out = [0]
    for j, y in enumerate(span):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def test_every_overlap_that_a_plain_search_is_sure_of_is_found(spark):
    rng = random.Random(8)
    vocabulary = prose(rng, 400).split()
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 2, 4, 9, 16, 33, 70)]
    texts = []
    for i, item in enumerate(items):
        for k in range(4):
            words = item.split()
            for at in rng.sample(range(len(words)), min(len(words) // 8, k)):
                words[at] = rng.choice(vocabulary)
            texts.append(" ".join([*rng.choices(vocabulary, k=rng.randint(0, 90)), *words, *rng.choices(vocabulary, k=rng.randint(0, 90))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    sure = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if best_overlap(item.split(), t.split()) >= 0.85}
    assert sure <= found and len(sure) >= len(texts)


def test_passes_of_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(9)
    items = [prose(rng, rng.randint(10, 50)) for _ in range(30)]
    texts = [prose(rng, 60) + " " + items[i] for i in range(0, 30, 2)] + [prose(rng, 80) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([*enumerate(items), (0, items[2]), (None, items[4]), (77, None)], "item_id long, text string")
    pairs = lambda: {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    whole = pairs()
    assert {(i, 2 * i) for i in range(15)} | {(1, 0)} == whole
    monkeypatch.setattr(decontamination, "RANK", 8)
    monkeypatch.setattr(decontamination, "PASS_BYTES", 1)
    monkeypatch.setattr(decontamination._blocks, "__defaults__", (8,))
    monkeypatch.setattr(decontamination.latent_space, "__defaults__", (8, 5))
    assert pairs() == whole and decontamination.decontaminated(docs, benchmark).count() == 22


def test_rows_are_judged_by_their_own_text(spark):
    rng = random.Random(10)
    item, other = prose(rng, 30), prose(rng, 80)
    leak = prose(rng, 40) + " " + item
    rows = [(1, leak, "a"), (1, other, "b"), (None, leak, "c"), (None, other, "d"), (2, leak, "e"), (2, leak, "f"), (3, None, "g"), (4, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    kept = decontamination.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == ["b", "d", "g", "h"]
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()) == [("1", 0), ("2", 0), ("None", 0)]


def test_block_sizes_are_bounded():
    items = decontamination._items([{"item_id": i, "text": prose(random.Random(i), n)} for i, n in enumerate([500] * 40 + [5] * 9 + [9000])])
    idf = np.ones(decontamination.TERMS, np.float32)
    sizes = [decontamination.Block(own, windows, idf).size() for own, windows in decontamination._blocks(items)]
    assert max(sizes) < decontamination.PASS_BYTES / 2


def test_the_latent_space_is_truncated_and_takes_passages_of_the_documents(spark):
    rng = random.Random(11)
    vocabulary = prose(rng, 2000).split()
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [{"item_id": i, "text": text(30)} for i in range(300)]
    texts = [text(rng.randint(1, 200)) for _ in range(900)]
    frame = lambda parts: spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(parts)
    idf, passages = decontamination.corpus_statistics(frame(2))
    again, same = decontamination.corpus_statistics(frame(5))
    assert 300 < len(passages) <= decontamination.WINDOWS and all((a == b).all() for a, b in zip(passages, same, strict=True)) and (idf == again).all()
    hasher = decontamination.WordHasher()
    spans = {bytes(decontamination._terms(h)[k : k + 32]) for h in (hasher.words([t.encode()])[0] for t in texts) for k in range(0, len(h), decontamination.BLOCK)}
    assert all(bytes(p) in spans for p in passages)
    (own, windows), = decontamination._blocks(iter(decontamination._items(items)))
    block = decontamination.Block(own, windows, idf, passages)
    assert block.vectors.shape[1] == decontamination.RANK < len(windows)
    assert np.linalg.norm(block.vectors[block.row[np.concatenate(passages[: len(windows)])]], axis=1).min() > 0
    copies = [(text(50) + " " + x["text"] + " " + text(50)).encode() for x in items]
    found = {(d, block.items[i].item_id) for d, _, i in decontamination.Finder([block], idf).find(copies)}
    assert found == {(i, i) for i in range(300)}


def test_texts_with_too_few_words_of_an_item_are_not_compared_in_order(monkeypatch):
    """17 of 32 words hold half of an item's weight, so they are looked at, but no order of them is enough."""
    rng = random.Random(12)
    items = [{"item_id": i, "text": prose(rng, 32)} for i in range(20)]
    other = lambda: prose(rng, 40, "ijklmnop")
    half = [(other() + " " + " ".join(x["text"].split()[:17]) + " " + other()).encode() for x in items]
    whole = [(other() + " " + x["text"] + " " + other()).encode() for x in items]
    calls, plain = [], decontamination.longest_common
    monkeypatch.setattr(decontamination, "longest_common", lambda *given: calls.append(1) or plain(*given))
    idf = np.ones(decontamination.TERMS, np.float32)
    (own, windows), = decontamination._blocks(iter(decontamination._items(items)))
    finder = decontamination.Finder([decontamination.Block(own, windows, idf)], idf)
    assert not finder.find(half) and not calls
    assert {(d, i) for d, _, i in finder.find(whole)} == {(i, i) for i in range(20)} and calls


def test_filters_leave_out_no_passage_that_a_plain_product_finds(monkeypatch):
    rng = random.Random(13)
    vocabulary = prose(rng, 150).split()
    items = decontamination._items([{"item_id": i, "text": " ".join(rng.choices(vocabulary, k=rng.randint(1, 80)))} for i in range(150)])
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 15, 16, 17, 40, 400]))).encode() for _ in range(60)] + [None, b"", "é ñ".encode()]
    idf = np.random.default_rng(13).uniform(0.01, 6, decontamination.TERMS).astype(np.float32)
    (own, windows), *_ = decontamination._blocks(iter(items))
    block = decontamination.Block(own, windows, idf)
    finder, seen = decontamination.Finder([block], idf), set()
    monkeypatch.setattr(decontamination, "_compare", lambda best, block, window, h, doc, start, cosine, close: seen.add((window[0], int(doc[start]), start - window[1], close)))
    monkeypatch.setattr(decontamination, "PART", 64)
    finder.find(texts)
    h, doc = finder.hasher.words(texts)
    t, wanted, sure = decontamination._terms(h), set(), 0
    for start in [k for d in set(doc.tolist()) for k in range(int(np.flatnonzero(doc == d)[0]), int(np.flatnonzero(doc == d)[-1]) + 1, decontamination.BLOCK)]:
        span = t[start : start + 2 * decontamination.BLOCK][doc[start : start + 2 * decontamination.BLOCK] == doc[start]]
        z, norm, held = block.vectors[block.row[span]].sum(axis=0), (idf[span] ** 2).sum(), block.inside[span].sum()
        dots = z @ block.latent
        cosines = dots / max(np.linalg.norm(z), np.sqrt(norm))
        for (i, lead), dot, cosine, length in zip(windows, dots.tolist(), cosines.tolist(), block.lengths.tolist(), strict=True):
            near = abs(cosine - decontamination.LEAST_COSINE) < 1e-4 or abs(dot / length - decontamination.LEAST_HELD) < 1e-4
            key = i, int(doc[start]), start - lead, cosine < decontamination.LEAST_COSINE
            if not near and held >= min(decontamination.LEAST_COSINE**2 * norm, block.light) and (cosine >= decontamination.LEAST_COSINE or dot >= decontamination.LEAST_HELD * length):
                wanted.add(key)
                sure += 1
            elif near:
                seen.discard(key)
                wanted.discard(key)
    assert sure > 1000 and seen - wanted == set() and wanted - seen == set()


def test_blocks_are_folded_by_place():
    rng = np.random.default_rng(14)
    items = decontamination._items([{"item_id": i, "text": prose(random.Random(i), 40)} for i in range(30)])
    (own, windows), = decontamination._blocks(iter(items))
    block = decontamination.Block(own, windows, np.ones(decontamination.TERMS, np.float32))
    sizes = rng.integers(0, 17, 200)
    begin, rows = np.cumsum(sizes) - sizes, rng.integers(0, len(block.vectors), sizes.sum())
    plain = np.array([block.vectors[rows[b : b + n]].sum(axis=0) for b, n in zip(begin, sizes, strict=True)])
    assert np.abs(block.fold(rows, begin, sizes) - plain).max() < 1e-5
    assert not block.fold(rows, begin[:3], np.zeros(3, np.int64)).any() and block.fold(rows, begin[:0], sizes[:0]).shape == (0, plain.shape[1])


def test_words_block_starts_and_document_frequencies_equal_plain_ones():
    rng = random.Random(15)
    alphabet = [b"a", b"B", b"b", b"7", b" ", b"\n", b"-", b"_", b"\x00", b"\x1f", "é".encode(), b"\xff"]
    hasher, same = decontamination.WordHasher(), {}
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else b"".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 200]))) for _ in range(rng.randint(0, 6))]
        words = [(d, w) for d, t in enumerate(texts) for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or b"").lower())]
        h, doc = hasher.words(texts)
        assert doc.tolist() == [d for d, _ in words] and all(same.setdefault(w, x) == x for (_, w), x in zip(words, h.tolist(), strict=True))
        if len(h):
            assert decontamination._block_starts(doc).tolist() == [k for k, d in enumerate(doc.tolist()) if (k - doc.tolist().index(d)) % decontamination.BLOCK == 0]
        t = decontamination._terms(h)
        assert (decontamination._document_frequencies(doc, t) == np.bincount([x for _, x in set(zip(doc.tolist(), t.tolist(), strict=True))], minlength=decontamination.TERMS)).all()
    assert len(set(same.values())) == len(same) > 500


def test_the_space_is_decomposed_from_all_passages_of_all_documents(spark):
    """The sums equal those of plain loops, whatever the partitioning, and every passage with a term in question is in one of them."""
    rng = random.Random(16)
    vocabulary = prose(rng, 300).split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 15, 16, 17, 33, 200]))) for _ in range(1000)]
    frame = lambda parts: spark.createDataFrame([(t,) for t in [*texts, None, "", "é"]], "text string").repartition(parts)
    idf = np.random.default_rng(16).uniform(0.01, 6, decontamination.TERMS).astype(np.float32)
    hasher, size = decontamination.WordHasher(), 2 * decontamination.BLOCK
    h, doc = hasher.words([" ".join(vocabulary).encode()])
    terms = np.unique(decontamination._terms(h))[::2]
    sums = decontamination.passage_sums(frame(2), idf, terms)
    assert sums.shape == (decontamination.RANK, len(terms)) and (sums == decontamination.passage_sums(frame(5), idf, terms)).all()
    plain, n = np.zeros((decontamination.RANK, len(terms))), 0
    for text in texts:
        t = decontamination._terms(hasher.words([text.encode()])[0])
        total = np.zeros((decontamination.RANK, decontamination.TERMS), np.int64)
        column = np.arange(decontamination.TERMS)
        h, doc = hasher.words([text.encode()])
        decontamination._add_passages(total, h, doc, idf, idf**2, column)
        wanted = np.zeros(decontamination.TERMS)
        for k in range(0, len(t), decontamination.BLOCK):
            span = t[k : k + size]
            wanted[np.unique(span)] += [idf[x] * (span == x).sum() / np.sqrt((idf[span].astype(float) ** 2).sum()) for x in np.unique(span)]
            n += 1
        if len(t) <= decontamination.BLOCK:  # one passage: one sum, one sign
            assert np.abs(np.abs(total).sum(axis=0) / decontamination.SCALE - wanted).max() < 1e-3 and (total != 0).any(axis=1).sum() == 1
        else:  # no term has more than its passages give, none is left out
            assert (np.abs(total).sum(axis=0) / decontamination.SCALE <= wanted + 1e-3).all() and total.any(axis=0)[t].mean() > 0.9
        plain += total[:, terms] / decontamination.SCALE
    assert n > 3000 and np.abs(plain - sums).max() < 1e-3
    items = decontamination._items([{"item_id": 0, "text": " ".join(rng.choices(vocabulary, k=30))}])
    (own, windows), = decontamination._blocks(iter(items))
    space = lambda given: decontamination.latent_space(own, windows, idf, [], (terms, given))[1]
    assert np.abs(space(sums) - space(np.where(np.arange(len(sums))[:, None] == 77, 0, sums))).max() > 1e-4


def test_the_pipelines_step_takes_all_passages_too(spark, monkeypatch):
    rng, given = random.Random(17), []
    item, plain = prose(rng, 40), decontamination.latent_space
    monkeypatch.setattr(decontamination, "latent_space", lambda *args: given.append(args) or plain(*args))
    texts = [prose(rng, 300) for _ in range(50)] + [prose(rng, 50) + " " + item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = decontamination.decontaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(50))
    _, _, idf, passages, (terms, sums) = given[0]
    assert set(np.concatenate(passages).tolist()) <= set(terms.tolist()) and (sums == decontamination.passage_sums(docs, idf, terms)).all() and sums.any(axis=1).mean() > 0.9
