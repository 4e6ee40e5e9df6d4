"""Packing where memory is small, and where keys are null or repeated."""

import numpy as np
import public_tokenizers
from ragloom.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_ids_do_not_depend_on_the_memory(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["some words, again. " * 9, "x" * 3000 + " y", "abc " * 50 + "z" * 300 + ".", "Ünï çødé \U0001f600", "<|endoftext|> it's", "a,b;c d.e " * 20, "w1 w2 w3 w4 w5 " * 30]
    for size in (0, 2000, 128 << 20):
        monkeypatch.setattr(packing, "MEMORY_BYTES", size)
        packing._memories.clear()
        encode = packing.make_encoder(TOKENIZER)
        for t in [*texts, *texts]:
            assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        kept = packing._memories[TOKENIZER][1]
        assert max(map(len, kept)) <= packing.LONG_CHUNK
    packing._memories.clear()


def test_hot_and_null_ids_spread_over_the_groups(spark, tmp_path):
    rows = [(None if i % 2 else 7, 0, 100 + i % 50, 1, 200) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").write.parquet(str(tmp_path / "p"))
    packed = packing.pack(spark.read.parquet(str(tmp_path / "p")), group_pieces=400)
    sizes = [r["count"] for r in packed.groupBy((packed.sequence_id / 2**32).cast("long").alias("g")).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 10 and max(sizes) < 800
    filled = packed.groupBy("sequence_id").agg({"length": "sum"}).toPandas()["sum(length)"]
    assert filled.max() <= 4096 and np.mean(filled) > 3500


def test_plain_words_skip_all_but_the_model(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, whole = Tokenizer.from_file(TOKENIZER), []

    class Counted:
        """The tokenizer, noting what is encoded in full."""

        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, part, **more):
            whole.extend(part)
            return tokenizer.encode_batch_fast(part, **more)

    monkeypatch.setitem(packing._memories, TOKENIZER, (Counted(), {}))
    encode = packing.make_encoder(TOKENIZER)
    text = "Plain WORDS, abc123x 42 7. a1b2 0x9f it's s t don't e-mail \u212a9 \u00e9t\u00e9 x\u0301y \u0661\u0662 zzqxj " + "ab9" * 40
    assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not [w for w in whole if w.isascii() and w.isalnum()] and "don't" in whole
    raw = "<|x ABC def9 Ab1"
    assert encode(raw).tolist() == tokenizer.encode(raw, add_special_tokens=False).ids


def test_words_of_other_letters_and_words_with_marks_skip_all_but_the_model(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, whole = Tokenizer.from_file(TOKENIZER), []

    class Counted:
        """The tokenizer, noting what is encoded in full."""

        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, part, **more):
            whole.extend(part)
            return tokenizer.encode_batch_fast(part, **more)

    monkeypatch.setitem(packing._memories, TOKENIZER, (Counted(), {}))
    text = "été ÜBER&&& naïve%%% plain*** straße. Ÿ_! o'er x'd. " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}," for i in range(600))
    assert packing.make_encoder(TOKENIZER)(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert {w for w in whole if any(c.isalpha() for c in w)} == {"o'er", "x'd."} and len(whole) < 12


def test_every_letter_and_mark_has_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(TOKENIZER), packing.make_encoder(TOKENIZER)
    for t in [f"ab{c}cd {c} x{c}. {c}!?'s a{c}{c}" for c in map(chr, range(0x250))]:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
