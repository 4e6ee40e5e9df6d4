"""Bin completion against the fewest windows found by trying everything; ids against the tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from ragloom.llm import completion, queries
from ragloom.llm.packing import best_fit_decreasing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n", "a\n\n\nb", "  a  b ", "it's. don't, 'll", "x\x1cy \x1f z", "tab\t\tq w 　 é \x85.", "<|endoftext|> a", "日本語。テキスト, ok", "1.5, 2.",
    "\U0001f600 \U0001f600\U0001f600.\r\n\r\n end  ", "a.b,c.", "½. Ⅷ, ².", "z" * 900 + ". " + "y" * 300, "w1 w2, w3. " * 400,
]


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("size", [0, 3000, 128 << 20])
def test_ids_do_not_depend_on_the_memory(monkeypatch, size):
    monkeypatch.setattr(completion, "MEMORY_BYTES", size)
    completion._memories.clear()
    encode = completion.make_encoder(TOKENIZER)
    tokenizer = reference()
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
    for part in (1 << 19, 5):
        monkeypatch.setattr(completion, "_PART", part)
        assert [x.tolist() for x in encode(ODD)] == want
    completion._memories.clear()


def fewest(items, window):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= window}:
            k = bins.index(room)
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_small_packings_have_the_fewest_windows():
    rng, improved = random.Random(3), 0
    for _ in range(250):
        window = rng.choice([20, 50, 100])
        items = np.array([rng.randrange(1, window + 1) if rng.random() < 0.5 else rng.randrange(max(1, window // 6), window // 2 + 1) for _ in range(rng.randrange(1, 13))])
        number, offset = completion.bin_completion(items, window, 20_000)
        best = fewest(items.tolist(), window)
        assert completion.lower_bound(np.bincount(items, minlength=window + 1), window) <= best == number.max() + 1
        improved += best_fit_decreasing(items, window)[0].max() + 1 > best
        for n in set(number.tolist()):
            at = 0
            for o, size in sorted(zip(offset[number == n].tolist(), items[number == n].tolist())):
                assert o == at
                at += size
            assert at <= window
    assert improved


def test_fillings_are_those_that_no_other_dominates():
    counts = np.bincount([6, 5, 4, 3, 3, 2], minlength=21)
    assert list(completion.fillings(counts, 6, 0, completion._Steps(10**6))) == [(6,)]
    found = list(completion.fillings(counts, 7, 0, completion._Steps(10**6)))
    assert found[0] in {(5, 2), (4, 3)} and {sum(f) for f in found} >= {7} and (2, 2) not in found
    assert list(completion.fillings(counts, 1, 0, completion._Steps(10**6))) == [()]


def test_search_never_worsens_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1025, 3000)
    number, _ = completion.bin_completion(lengths)
    assert number.max() <= best_fit_decreasing(lengths, 1024)[0].max()
    assert np.bincount(number, weights=lengths).max() <= 1024


def test_every_id_lies_in_one_piece(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1, " "), (98, None), (99, "many words here. " * 700)]
    spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, piece int, start string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_bin_completion(spark, str(tmp_path)).toPandas()
    tokenizer = reference()
    want = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(str(doc_id), p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(str(None if d != d or d is None else int(d)), *map(int, r)) for d, *r in found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got) == sorted(want)
    for _, frame in found.groupby("sequence_id"):
        frame = frame.sort_values("offset")
        assert frame["offset"].tolist() == [0, *frame["length"].cumsum().tolist()[:-1]] and frame["length"].sum() <= 1024
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    assert completion.packed_documents(empty, TOKENIZER).count() == 0


def test_null_and_repeated_ids_spread_over_the_groups(spark, tmp_path):
    rows = [(None if i % 2 else 7, 0, 0, 100 + i % 50, 1) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").write.parquet(str(tmp_path / "p"))
    packed = completion.pack(spark.read.parquet(str(tmp_path / "p")), group_pieces=400)
    sizes = [r["count"] for r in packed.groupBy((packed.sequence_id / 2**32).cast("long").alias("g")).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 10 and max(sizes) < 800


def test_new_words_go_to_the_tokenizers_model_together(monkeypatch):
    completion._memories.clear()
    completion.make_encoder(TOKENIZER)
    tokenizer, held, words_only, alphabet = completion._memories[TOKENIZER]
    calls, full = [], []

    class Counted:
        def __init__(self, whole, seen):
            self.whole, self.seen = whole, seen

        def encode(self, text, **more):
            self.seen.append(text)
            return self.whole.encode(text, **more)

        def encode_batch_fast(self, part, **more):
            self.seen.extend(part)
            return self.whole.encode_batch_fast(part, **more)

    monkeypatch.setitem(completion._memories, TOKENIZER, (Counted(tokenizer, full), held, Counted(words_only, calls), alphabet))
    text = "\n".join(f"Wörd{chr(97 + i % 26)}{chr(97 + i // 26)}, üb{chr(97 + i % 26)}{chr(97 + i // 26)}&&&" for i in range(600)) + " it's"
    assert next(completion.make_encoder(TOKENIZER)([text])).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) == 2 and len(full) < 8 and not [t for t in full if "rd" in t]
    completion._memories.clear()


def test_chunks_are_those_of_the_pattern_wherever_white_space_stands():
    rng = random.Random(12)
    tokenizer, encode = reference(), completion.make_encoder(TOKENIZER)
    for alphabet in ("ab c.,\né' \n", "ab \t\r\n\x0b\x1c\x85\xa0 \x00x."):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(1500)]
        assert [x.tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
