"""Packing: best-fit decreasing of token pieces into windows, with a segment tree over remaining capacities.

Tokenising, cutting and hashing are one narrow pass over the texts. Only (doc_id, start, length) rows are dealt out to packing
groups of bounded size, so neither the corpus nor a hot source meets in one task.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import written

#: Id that ends each document, and the window's size (fixed values).
END_ID, WINDOW = 2, 4096
#: Pieces that one packing group holds on average: groups grow in number, not in size.
GROUP_PIECES = 20000
#: Bytes of chunks between white space, and of their ids, that a task remembers; the memory starts afresh beyond them.
MEMORY_BYTES = 128 << 20
#: Longer chunks are not remembered beyond their own text. A remembered chunk takes so many bytes besides.
LONG_CHUNK, _ENTRY = 256, 160
#: Rows of a batch whose pieces are put out together.
_ROWS = 1000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


_RUNS = re.compile("[a-z]+|[0-9]")
#: Letters that lower-casing maps to one letter each and that normalisation leaves alone: a run of them is one stretch for the tokenizer.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Such a word, and ASCII punctuation after it up to the chunk's end, which is a stretch of its own.
_WORD = f"^(?P<word>[{_LETTERS}]+)(?P<mark>[!-/:-@\\[-`{{-~]*)$"
#: Bytes of texts that are tokenised together (a longer text stands alone), and words that are joined for the tokenizer's model.
_PART, _JOINED = 1 << 20, 1024
_memories: dict[str, tuple] = {}
_models: dict[str, tuple] = {}


def make_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids (uint32); see ``make_text_encoder``."""
    encode = make_text_encoder(path)
    return lambda text: next(encode(pa.array([text], pa.string())))


def make_text_encoder(path: str) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """Texts to ids (uint32) of a tokenizer that lower-cases and whose pre-tokenizer never joins what ASCII white space parts.

    Ids of each chunk between white space are remembered for the life of the Python worker. New words of letters skip all but the
    tokenizer's model, which takes many of them joined: the ids that end a word tell them apart. Runs of ASCII letters and single digits
    go to the model one by one. Punctuation after a word is a token run of its own, so such chunks reuse the ids of the word.
    """
    if path not in _memories:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        _memories[path] = Tokenizer.from_file(path), Held()
    tokenizer, memory = _memories[path]
    held = memory if isinstance(memory, Held) else Held(memory)
    if path not in _models:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        vocabulary, words_only = tokenizer.get_vocab(), Tokenizer(tokenizer.model)
        words_only.pre_tokenizer = CharDelimiterSplit(" ")
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _models[path] = words_only, byte_alphabet().replace("\u0120", " "), ends
    words_only, alphabet, ends = _models[path]
    model, digits = tokenizer.model, {d: raw_ids(tokenizer.encode(d, add_special_tokens=False).ids) for d in "0123456789"}

    def word_ids(words: pa.Array) -> list[bytes]:
        out, words = [], pc.utf8_lower(words)
        for at in range(0, len(words), _JOINED):
            spelt = codecs.charmap_decode(joined(words.slice(at, _JOINED), " "), "strict", alphabet)[0]
            raw = raw_ids(words_only.encode_batch_fast([spelt], add_special_tokens=False)[0].ids)
            stops = [0, *(4 * np.flatnonzero(ends[np.frombuffer(raw, "<u4")]) + 4).tolist()]
            out += [raw[a:b] for a, b in pairwise(stops)]
        return out

    def full_ids(chunks: list[str]) -> list[bytes]:
        return [raw_ids(e.ids) for at in range(0, len(chunks), 4096) for e in tokenizer.encode_batch_fast(chunks[at : at + 4096], add_special_tokens=False)]

    def other_ids(chunks: list[str]) -> list[bytes]:
        plain = {c: b"".join([raw_ids([t.id for t in model.tokenize(x)]) if x not in digits else digits[x] for x in _RUNS.findall(c)]) for c in chunks if c.isascii() and c.isalnum() and c == c.lower()}
        odd = [c for c in chunks if c not in plain]
        known = plain | dict(zip(odd, full_ids(odd), strict=True))
        return [known[c] for c in chunks]

    def learn(chunks: pa.Array) -> list[bytes]:
        return ids_by_word(chunks, _WORD, word_ids, full_ids, other_ids)

    def encode(texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _PART, side="right")))
            part = texts.slice(at, end - at)
            special = pc.match_substring(part, "<|")
            lower = pc.ascii_lower(part)
            yield from held.ids(pc.ascii_split_whitespace(pc.if_else(special, part, lower) if pc.any(special).as_py() else lower), learn, MEMORY_BYTES, LONG_CHUNK, _ENTRY)
            at = end

    return encode


def raw_ids(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit numbers."""
    return array("I", ids).tobytes()


def joined(words: pa.Array, by: str) -> bytes:
    """The words in UTF-8 with a separator between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), by)[0].as_buffer().to_pybytes()


def byte_strings(values: pa.Array) -> list[bytes]:
    """The bytes of each string or binary value (32-bit places, no nulls)."""
    _, places, content = values.buffers()
    stops = np.frombuffer(places, np.int32)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    raw = content.to_pybytes() if content else b""
    return [raw[a:b] for a, b in pairwise(stops)]


def byte_alphabet() -> str:
    """The characters that byte-level tokenizers write for bytes 0 to 255; those of characters from U+0800 on are left undefined."""
    from tokenizers.pre_tokenizers import ByteLevel

    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    table = {byte: sign for c in map(chr, [*range(0x100), *range(0x100, 0x800, 0x40)]) for byte, sign in zip(c.encode(), spell(c)[0][0], strict=True)}
    return "".join(table.get(i, "\ufffe") for i in range(256))


def ids_by_word(chunks: pa.Array, pattern: str, word_ids: Callable[[pa.Array], list[bytes]], mark_ids: Callable[[list[str]], list[bytes]], other_ids: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Ids of each chunk: those of its word and of the marks after it, where the pattern's groups part it so; each word is taken once."""
    parts = pc.extract_regex(chunks, pattern)
    fits = parts.is_valid()
    there = parts.filter(fits)
    words, marks = (pc.struct_field(there, name).dictionary_encode() for name in ("word", "mark"))
    some = mark_ids(marks.dictionary.to_pylist())
    tables = [pa.array(x, pa.binary()).take(y.indices) for x, y in ((word_ids(words.dictionary), words), (some, marks))]
    found = byte_strings(pc.binary_join_element_wise(*tables, b""))
    others = chunks.filter(pc.invert(fits)).to_pylist()
    if not others:
        return found
    found, more = iter(found), iter(other_ids(others))
    return [next(found if fit else more) for fit in fits.to_pylist()]


class Held(dict):
    """Ids of chunks that were met before, up to a number of bytes; equal chunks of a part are looked up once."""

    size = 0

    def ids(self, chunked: pa.ListArray, learn: Callable[[pa.Array], list[bytes]], most: int, long: int, entry: int) -> Iterator[np.ndarray]:
        """The ids (uint32) of each list's chunks, one after another. Chunks over ``long`` bytes are not remembered."""
        coded = chunked.flatten().dictionary_encode()
        chunks, bounds = coded.dictionary, chunked.offsets.to_numpy() - chunked.offsets[0].as_py()
        keys = byte_strings(chunks)
        found = list(map(self.get, keys))
        missing = missing_places(found)
        if missing:
            learnt = learn(chunks.take(pa.array(missing, pa.int64())))
            new = {keys[i]: ids for i, ids in zip(missing, learnt, strict=True) if len(keys[i]) <= long}
            size = sum(map(len, new)) + sum(map(len, new.values())) + entry * len(new)
            if self.size + size > most:
                self.clear()
                self.size = 0
            self.update(new)
            self.size += size
            for i, ids in zip(missing, learnt):
                found[i] = ids
        text_ids = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(text_ids.buffers()[1], np.int64, len(text_ids) + 1) // 4 if len(text_ids) else np.zeros(1, np.int64)
        flat = np.frombuffer(text_ids.buffers()[2] or b"", "<u4", int(ends[-1]))
        for a, b in pairwise(ends[bounds].tolist()):
            yield flat[a:b]


def missing_places(values: list) -> list[int]:
    """Places of None."""
    out, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def token_pieces(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents' ids: full windows first, then the rest. A null text counts as empty: its only id is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_text_encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                rows: list[list[int]] = [[], [], [], [], []]
                for doc_id, found in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                    ids = np.concatenate([found, end])
                    for start in range(0, len(ids), window):
                        part = ids[start : start + window]
                        for column, value in zip(rows, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, _PIECES)


class CapacityTree:
    """Segment tree over remaining capacities 0..size: each node counts the open windows below it."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of at least ``need`` with an open window."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def take(self, capacity: int) -> int:
        node = capacity + self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece, in the order given. Longest first; each goes to the tightest window that holds it."""
    tree, numbers, offsets, opened = CapacityTree(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity = tree.tightest(need)
        if capacity is None:
            number, capacity, opened = opened, window, opened + 1
        else:
            number = tree.take(capacity)
        numbers[i], offsets[i] = number, window - capacity
        if capacity > need:
            tree.add(capacity - need, number)
    return numbers, offsets


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with sequence_id, offset and sequence_length (the ids in it), packed by groups.

    The group is a hash of the piece and its place in the table (which is written, so the place is the same whenever a task is
    repeated), over a number of groups in proportion to the pieces: equal rows, rows without doc_id, hot sources and long documents
    all spread evenly. sequence_id is group * 2^32 + number. Extra columns stay.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    names = [f.name for f in pieces.schema]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "length"], kind="stable", na_position="first")
        number, offset = best_fit_decreasing(frame["length"].to_numpy(), window)
        filled = np.bincount(number, weights=frame["length"].to_numpy()).astype(np.int64)
        out = frame[names].copy()
        out["sequence_id"], out["offset"], out["sequence_length"] = number + (frame["packing_group"].to_numpy() << 32), offset, filled[number]
        return out

    dealt = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("packing_group").applyInPandas(run, f"{fields}, sequence_id long, offset long, sequence_length long")


def packed_documents(documents: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, padded_length.

    A sequence is padded to the window, unless its length is a power of two. Repeated rows are packed each on its own.
    """
    packed = pack(written(token_pieces(documents, tokenizer, window), "pieces"), window)
    length = F.col("sequence_length")
    return packed.withColumn("padded_length", F.when(length.bitwiseAND(length - 1) == 0, length).otherwise(F.lit(window).cast("long")))
