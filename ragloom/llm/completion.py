"""Packing into as few windows as possible: bin completion with branch and bound over groups of token pieces.

Tokenising and cutting are one narrow pass. Rows of (doc_id, piece, start, length) are dealt to groups of bounded size; in each group
the windows are completed one after another around the largest piece left, by the fullest fillings that no other filling
dominates. The best-fit solution is the first incumbent; a branch whose windows and waste cannot beat the incumbent is cut off.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import written
from ragloom.llm.packing import Held, best_fit_decreasing, byte_alphabet, ids_by_word, joined, raw_ids

#: Id that ends each document, and the window's size (fixed values).
END_ID, WINDOW = 2, 1024
#: Pieces that one group holds on average: groups grow in number, not in size.
GROUP_PIECES = 20_000
#: Windows that are searched together, steps of one search, and searches of a group. The incumbent stands when they are used up.
SEARCHED, STEPS, TRIES = 300, 20_000, 6
#: Bytes of chunks and of their ids that a task remembers (the memory starts afresh beyond them); longer chunks are not remembered.
MEMORY_BYTES, LONG_CHUNK, _ENTRY = 256 << 20, 256, 160
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: White space as the tokenizer's own pattern has it (fixed values).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stretches that the tokenizer never joins to their neighbours: a word with the space before it, or white space.
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: White space besides the space and the line end, in ASCII and beyond.
_OTHER_WHITE, _WIDE_WHITE = "\t\x0b\x0c\r", re.compile(f"[{_WHITE[len('\\t-\\r '):]}]")
#: A word of letters that is one stretch for the tokenizer, and ASCII punctuation after it up to the chunk's end, which is another.
_WORD = "^(?P<word> ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)(?P<mark>[!-/:-@\\[-`{-~]*)$"
_SPACES = re.compile(f"[{_WHITE}]*")
_SPECIAL = "<|endoftext|>"
#: Characters of texts that are tokenised together (a longer text stands alone), words that are joined, rows put out together.
_PART, _JOINED, _ROWS = 1 << 20, 1024, 1000

_memories: dict[str, tuple] = {}


def make_encoder(path: str) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """Texts to ids (uint32) of a byte-level tokenizer. Ids of chunks are remembered for the life of the Python worker.

    New words of letters skip all but the tokenizer's model, which takes many of them joined by line ends, each a token of its own.
    """
    if path not in _memories:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        tokenizer = Tokenizer.from_file(path)
        words_only, alphabet = Tokenizer(tokenizer.model), byte_alphabet()
        end = alphabet[0x0A]
        # Where no token holds a line end after anything else, a word and its line end may go to the model as one stretch.
        words_only.pre_tokenizer = Split(end, "isolated" if any(end in t[1:] and t.strip(end) for t in tokenizer.get_vocab()) else "merged_with_previous")
        _memories[path] = tokenizer, Held(), words_only, alphabet
    tokenizer, held, words_only, alphabet = _memories[path]
    ids_of = lambda t: raw_ids(tokenizer.encode(t, add_special_tokens=False).ids)
    line_end = int.from_bytes(ids_of("\n"), "little")

    def parted_ids(raw: bytes) -> list[bytes]:
        stops = [-4, *(4 * np.flatnonzero(np.frombuffer(raw, "<u4") == line_end)).tolist(), len(raw)]
        return [raw[a + 4 : b] for a, b in pairwise(stops)]

    def word_ids(words: pa.Array) -> list[bytes]:
        out = []
        for at in range(0, len(words), _JOINED):
            spelt = codecs.charmap_decode(joined(words.slice(at, _JOINED), "\n"), "strict", alphabet)[0]
            out += parted_ids(raw_ids(words_only.encode_batch_fast([spelt], add_special_tokens=False)[0].ids))
        return out

    def other_ids(chunks: list[str]) -> list[bytes]:
        known = {c: ids_of(c) for c in chunks if _SPACES.fullmatch(c)}
        odd = [c for c in chunks if c not in known]
        for at in range(0, len(odd), _JOINED):
            part = odd[at : at + _JOINED]
            known |= zip(part, parted_ids(ids_of("\n".join(part))), strict=True)
        return [known[c] for c in chunks]

    def learn(chunks: pa.Array) -> list[bytes]:
        return ids_by_word(chunks, _WORD, word_ids, lambda marks: [ids_of(m) for m in marks], other_ids)

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _PART):
                size += len(texts[end])
                end += 1
            yield from part_ids(texts[at:end])
            at = end

    def part_ids(texts: list[str]) -> Iterator[np.ndarray]:
        apart = [_SPECIAL in t or "\0" in t for t in texts]
        parted = pc.split_pattern(pa.array(["" if alone else _parted(t) for t, alone in zip(texts, apart)], pa.string()), "\0")
        for text, alone, ids in zip(texts, apart, held.ids(parted, learn, MEMORY_BYTES, LONG_CHUNK, _ENTRY), strict=True):
            yield np.frombuffer(ids_of(text), dtype="<u4") if alone else ids

    return encode


def _parted(text: str) -> str:
    """The text with a null character between its chunks (empty ones do no harm). Where white space is one space or line end at a time,
    each opens a chunk and nothing else does."""
    double = any(x in text for x in ("  ", "\n\n", " \n", "\n "))
    if double or any(c in text for c in _OTHER_WHITE) or not text.isascii() and _WIDE_WHITE.search(text):
        return "\0".join(_CHUNK.findall(text))
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


def token_pieces(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents' ids. Only documents over the window are cut: the first piece takes what full windows leave.

    A null text counts as empty: its only id is the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = make_encoder(tokenizer), np.array([end_id], dtype="<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                rows: list[list] = [[], [], [], [], []]
                for doc_id, found in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids = np.concatenate([found, end])
                    stops = range(len(ids) % window or window, len(ids) + 1, window) if len(ids) > window else [len(ids)]
                    start = 0
                    for piece, stop in enumerate(stops):
                        for column, value in zip(rows, (doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())), strict=True):
                            column.append(value)
                        start = stop
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(run, _PIECES)


def lower_bound(counts: np.ndarray, window: int) -> int:
    """Windows that any packing of counts[length] pieces needs: for every threshold, pieces over half a window stand alone, and what
    the pieces between the threshold and half exceed of the room beside them needs more."""
    lengths = np.arange(window + 1)
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])  # below a length
    half = window // 2
    k = np.arange(half + 1)
    large, beside = n[-1] - n[half + 1], n[window - k + 1] - n[half + 1]
    room = beside * window - (s[window - k + 1] - s[half + 1])
    small = s[half + 1] - s[k]
    return int((large + np.maximum(0, -(-(small - room) // window))).max())


class _Steps:
    """Steps of enumeration that are left; one node of the search is at least one step."""

    def __init__(self, most: int) -> None:
        self.left = most


def fillings(counts: np.ndarray, room: int, least: int, steps: _Steps) -> Iterator[tuple[int, ...]]:
    """Undominated multisets of lengths with a sum of ``least`` to ``room``, fullest first and, of equal sums, fewest pieces first.

    A filling is dominated if one piece that is left could stand in the place of some of its pieces and fill the window as well
    or better. A single piece that fills the room dominates all others.
    """
    if room and counts[room]:
        yield (room,)
        return
    counts = counts.copy()
    sums = np.cumsum(counts * np.arange(len(counts)))
    whole = int(np.searchsorted(sums, room, side="right"))  # so many pieces fit at most: the smallest ones
    fitting = int(counts[:whole].sum()) + (room - int(sums[whole - 1]) if whole else room) // max(whole, 1)
    for total in range(room, max(least, 1) - 1, -1):
        if counts[total]:  # one piece of this length dominates every other filling with this sum
            if not counts[total + 1 : room + 1].any():
                yield (total,)
            continue
        for size in range(2, fitting + 1):
            for found in _multisets(counts, total, size, total, steps):
                if not _dominated(counts, found, room - total):
                    yield found
            if steps.left <= 0:
                return
    if least <= 0 and not fitting:
        yield ()


def _multisets(counts: np.ndarray, total: int, size: int, most: int, steps: _Steps) -> Iterator[tuple[int, ...]]:
    """Multisets of ``size`` (2 at least) lengths up to ``most`` with exactly this sum, largest first."""
    steps.left -= 1
    if size == 2:
        low = np.arange(max(1, total - most), total // 2 + 1)
        fits = (counts[low] > 0) & (counts[total - low] > 0)
        if len(low) and 2 * low[-1] == total and counts[low[-1]] < 2:
            fits[-1] = False
        yield from ((total - a, a) for a in low[fits].tolist())
        return
    least, high = -(-total // size), min(most, total - size + 1)  # the largest is at least its share, the others at least 1
    for a in (np.flatnonzero(counts[least : high + 1])[::-1] + least).tolist():
        if steps.left <= 0:
            return
        counts[a] -= 1
        try:
            for rest in _multisets(counts, total - a, size - 1, a, steps):
                yield (a, *rest)
        finally:
            counts[a] += 1


def _dominated(counts: np.ndarray, found: tuple[int, ...], slack: int) -> bool:
    if len(found) > 6:
        return False  # the subsets of large fillings are too many to look at; more fillings are tried, none is lost
    left = counts.copy()
    np.subtract.at(left, list(found), 1)
    parts = {(sum(part), size == 1) for size in range(1, len(found)) for part in combinations(found, size)}
    return any(left[s + alone : s + slack + 1].any() for s, alone in parts)


def search(counts: np.ndarray, window: int, best: int, steps: int) -> list[tuple[int, ...]] | None:
    """A packing of counts[length] pieces into fewer than ``best`` windows, or None where none was found within the steps.

    Depth first: each node completes the window of the largest piece left. A branch ends when the waste so far, or the lower bound of
    what is left, no longer allows fewer windows than the incumbent; every better packing becomes the incumbent.
    """
    counts, left = counts.copy(), _Steps(steps)
    total, bound = int((counts * np.arange(window + 1)).sum()), lower_bound(counts, window)
    chosen: list[tuple[int, ...]] = []
    stack: list[Iterator[tuple[int, ...]]] = []
    found, waste, forward = None, 0, True
    while best > bound and left.left > 0:
        left.left -= 1
        if forward:
            pieces = np.flatnonzero(counts)
            if not len(pieces):
                found, best = list(chosen), len(chosen)
                forward = False
            elif len(chosen) + lower_bound(counts, window) >= best:
                forward = False
            else:
                largest = int(pieces[-1])
                counts[largest] -= 1
                room = window - largest
                stack.append((largest, fillings(counts, room, room - ((best - 1) * window - total - waste), left)))
        if not forward:
            if not stack:
                break
            if len(chosen) == len(stack):  # take back the window that was completed last
                done = chosen.pop()
                waste -= window - sum(done)
                np.add.at(counts, list(done[1:]), 1)
        largest, options = stack[-1]
        filling = next(options, None)
        if filling is None or waste + window - largest - sum(filling) > (best - 1) * window - total:
            stack.pop()
            counts[largest] += 1
            forward = False
            continue
        np.subtract.at(counts, list(filling), 1)
        chosen.append((largest, *filling))
        waste += window - largest - sum(filling)
        forward = True
    return found


def bin_completion(lengths: np.ndarray, window: int = WINDOW, steps: int = STEPS, tries: int = TRIES) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece, in the order given: best fit first, then the search for fewer windows.

    Up to SEARCHED windows are searched together. Of more, the search takes the windows that best fit leaves with the most waste and
    some that hold several pieces, drawn anew for each of the ``tries``, and replaces them where it finds fewer. It ends where the
    lower bound is met. Each search has ``steps`` steps, so the time does not grow faster than the pieces, and the packing is never
    worse than best fit.
    """
    numbers, offsets = best_fit_decreasing(lengths, window)
    if not len(lengths):
        return numbers, offsets
    used, bound = int(numbers.max()) + 1, lower_bound(np.bincount(lengths, minlength=window + 1), window)
    for attempt in range(tries if used > SEARCHED else 1):
        if used == bound:
            break
        ids, own = np.unique(numbers, return_inverse=True)
        waste, pieces = window - np.bincount(own, weights=lengths).astype(np.int64), np.bincount(own)
        draw = np.random.default_rng(attempt)
        worst = np.argsort(-waste, kind="stable")[: SEARCHED // 4]
        several = np.setdiff1d(np.flatnonzero(pieces > 2), worst)
        chosen = np.concatenate([worst, draw.permutation(several)[: SEARCHED * (attempt % 3 + 1) // 3]]) if used > SEARCHED else np.arange(used)
        inside = np.flatnonzero(np.isin(own, chosen))
        better = search(np.bincount(lengths[inside], minlength=window + 1), window, len(chosen), steps)
        if better is not None:
            numbers[inside], offsets[inside] = _placed(lengths[inside], better, ids[chosen])
            used -= len(chosen) - len(better)
    return numbers, offsets


def _placed(lengths: np.ndarray, packing: list[tuple[int, ...]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece of a packing whose windows get the first of these numbers."""
    order, ends = np.argsort(lengths, kind="stable"), np.cumsum(np.bincount(lengths))
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, filling in zip(ids.tolist(), packing):
        at = 0
        for length in filling:
            ends[length] -= 1
            piece = order[ends[length]]
            numbers[piece], offsets[piece] = number, at
            at += length
    return numbers, offsets


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces (a written table) with sequence_id and offset, packed by groups.

    The group is a hash of the piece and its place in the table, over a number of groups in proportion to the pieces: equal rows,
    rows without doc_id, hot sources and long documents all spread evenly. sequence_id is group * 2^32 + number. Extra columns stay.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    names = pieces.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "length"], kind="stable", na_position="first")
        number, offset = bin_completion(frame["length"].to_numpy(), window)
        return frame[names].assign(sequence_id=number + (frame["packing_group"].to_numpy() << 32), offset=offset)

    dealt = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("packing_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def packed_documents(documents: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed each on its own.

    Other columns of the documents are left out; an empty table gives no rows.
    """
    return pack(written(token_pieces(documents, tokenizer, window), "completion-pieces"), window)
