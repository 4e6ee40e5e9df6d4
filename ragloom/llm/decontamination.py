"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words with TF-IDF weights over hashed terms; the inverse frequencies come from
all documents. A truncated randomised singular value decomposition of benchmark passages and of all passages of the documents (as signed
sums of a fixed number) spans a latent space, all document passages are folded into it by sums of word vectors, and those
whose cosine to a benchmark passage is high enough, or that hold enough of its weight there, are compared word by word: a longest
common subsequence, and the item's answer (its last sentence), which tells paraphrases from texts that are merely alike. Passes over the documents are narrow; only sums of fixed size and found
pairs are shuffled. Blocks of the benchmark go to the tasks together, as many as fit a fixed size, so the documents are read once
for some thousands of items.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import WordHasher, slices

#: Passages are two blocks of words long and one block apart.
BLOCK = 16
TERMS = 1 << 16
#: Benchmark passages of one decomposition, and passages of the documents whose words have vectors too; directions that it keeps, and
#: sums of all passages of the documents that it takes. Further random directions that are drawn to find them.
WINDOWS, RANK, OVERSAMPLE = 384, 192, 16
#: Cosine from which a passage is compared with an item.
LEAST_COSINE = 0.5
#: Sums of passages are whole numbers, this many to a length of 1, so that their order does not matter; terms of a sum in a row.
SCALE, PIECE = 1 << 16, 256
#: Passages that are folded into the space at a time.
PART = 512
#: Share of an item window's weight from which a passage that holds it is compared. Wherever a window of up to a passage's
#: length is copied, two neighbouring passages hold all of it, so one of them holds half.
LEAST_HELD = 0.499
#: Least weight of a term, so that items of words that are in all documents have weight.
LEAST_IDF = 0.01
#: Shares of an item's words in common order: contaminated; contaminated if the answer is there as well; share of the answer.
SURE, LIKELY, ANSWER = 0.75, 0.55, 0.6
#: Bytes of blocks that go to the tasks in one pass.
PASS_BYTES = 96 << 20
_SLACK = 12
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)")


@dataclass
class Item:
    """A benchmark item: its words as hashes, and where its answer begins."""

    item_id: int
    words: np.ndarray
    answer: np.ndarray


def answer_of(text: str) -> str:
    """The last sentence; the last quarter of the words of a single sentence."""
    sentences = [s for s in _SENTENCE.split(text.strip()) if s.strip()]
    if len(sentences) > 1:
        return sentences[-1]
    words = text.split()
    return " ".join(words[-max(1, len(words) // 4) :])


def _terms(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(TERMS - 1)).astype(np.int64)


def corpus_statistics(documents: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """(idf of every hashed term over all documents, terms of up to WINDOWS of their passages).

    Counts of a fixed size from each task, added up by Spark. Every document offers one passage for one of WINDOWS places, both by a
    hash of its words, and of each place the least hash is drawn: a sample of all documents that no partitioning changes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, drawn = WordHasher(), np.zeros(TERMS + 1, np.int64), {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                h, doc = hasher.words(texts[a:b])
                t = _terms(h)
                total[:TERMS] += _document_frequencies(doc, t)
                _draw(drawn, h, doc, t)
            total[TERMS] += batch.num_rows
        filled, places = np.flatnonzero(total), np.array(sorted(drawn), np.int64)
        # A row a word of a passage: the hash above, the term below, so that the least of each word's rows are those of one passage.
        words = np.zeros((len(places), 2 * BLOCK), np.int64)
        for k, p in enumerate(places.tolist()):
            rank, terms = drawn[p]
            words[k, : len(terms)] = np.array(terms) + 1
            words[k] |= rank >> 17 << 17
        at = (TERMS + 1 + places[:, None] * 2 * BLOCK + np.arange(2 * BLOCK)).ravel()
        columns = [pa.array(np.concatenate([filled, at])), pa.array(np.concatenate([total[filled], np.zeros_like(at)])), pa.array(np.concatenate([np.zeros_like(filled), words.ravel()]), mask=np.arange(len(filled) + len(at)) < len(filled))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n", "word"])

    texts = documents.select(F.col("text").cast("binary").alias("text")).where("text is not null")
    sums = texts.mapInArrow(run, "term long, n long, word long").groupBy("term").agg(F.sum("n").alias("n"), F.min("word").alias("word")).toArrow()  # at most TERMS + 1 + 2 * BLOCK * WINDOWS rows
    term, n, word = sums.column(0).to_numpy(), sums.column(1).to_numpy(), sums.column(2).fill_null(0).to_numpy()
    found, drawn, counted = np.zeros(TERMS + 1), np.zeros((WINDOWS, 2 * BLOCK), np.int64), term <= TERMS
    found[term[counted]] = n[counted]
    drawn.ravel()[term[~counted] - TERMS - 1] = word[~counted] & ((1 << 17) - 1)
    idf = np.maximum(np.log((1 + found[TERMS]) / (1 + np.minimum(found[:TERMS], found[TERMS]))), LEAST_IDF).astype(np.float32)
    return idf, [x[x > 0] - 1 for x in drawn if x.any()]


def _document_frequencies(doc: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Documents of each term; the words of a document stand together."""
    order = np.argsort(t.astype(np.uint16), kind="stable")
    t, doc = t[order], doc[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(t[new], minlength=TERMS)


def _draw(drawn: dict[int, tuple[int, list[int]]], h: np.ndarray, doc: np.ndarray, t: np.ndarray) -> None:
    """Puts the passages with the least hash of each place into ``drawn``: hash and terms. A document offers one passage, at a hashed block."""
    if not len(h):
        return
    mix = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([first, [len(h)]]))
    with np.errstate(over="ignore"):
        own = mix(h[first] + mix(h[first + size // 2] + mix(h[first + size - 1] + size.astype(np.uint64))))
        start = first + (own % (-(-size // BLOCK)).astype(np.uint64)).astype(np.int64) * BLOCK
        own = mix(own)
    end = np.minimum(start + 2 * BLOCK, first + size)
    place, rank = ((own >> np.uint64(8)) % np.uint64(WINDOWS)).astype(np.int64), (mix(own) >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((rank, place))
    for k in order[np.concatenate([[True], np.diff(place[order]) > 0])].tolist():
        p, r = int(place[k]), int(rank[k])
        if p not in drawn or r < drawn[p][0]:
            drawn[p] = r, t[start[k] : end[k]].tolist()


def benchmark_terms(benchmark: DataFrame) -> np.ndarray:
    """Terms of a benchmark, in order; at most TERMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found = WordHasher(), np.zeros(TERMS, bool)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                found[_terms(hasher.words(texts[a:b])[0])] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found))], names=["term"])

    texts = benchmark.select(F.col("text").cast("binary").alias("text")).where("text is not null")
    return np.unique(texts.mapInArrow(run, "term long").distinct().toArrow().column(0).to_numpy())


def passage_sums(documents: DataFrame, idf: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """All passages of all documents, over ``terms``, as RANK sums of their rows of length 1.

    A passage goes to one sum, with a sign, both by a hash of its document and its place there: the product of a sparse random matrix
    with that of all passages, whose directions it keeps. A task adds up its own, Spark those of the tasks.
    """
    rank, wide = RANK, -(-len(terms) // PIECE) * PIECE
    column, squares = np.full(TERMS, -1, np.int64), idf**2
    column[terms] = np.arange(len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = WordHasher(), np.zeros(rank * wide, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                h, doc = hasher.words(texts[a:b])
                if len(h):
                    _add_passages(total.reshape(rank, wide), h, doc, idf, squares, column)
        parts = total.reshape(-1, PIECE)
        yield from _sum_rows(np.flatnonzero(parts.any(axis=1)), parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, PIECE)
            for k, at in enumerate(batch.column(0).to_pylist()):
                own[at] = own[at] + values[k] if at in own else values[k].copy()
        yield from _sum_rows(np.array(list(own), np.int64), own)

    texts = documents.select(F.col("text").cast("binary").alias("text")).where("text is not null")
    rows = texts.mapInArrow(run, "at long, sums array<long>").repartition("at").mapInArrow(add, "at long, sums array<long>").toArrow()  # RANK rows for PIECE terms at most
    out = np.zeros((rank * wide // PIECE, PIECE), np.float32)
    if rows.num_rows:
        out[rows.column(0).to_numpy()] = rows.column(1).combine_chunks().flatten().to_numpy().reshape(-1, PIECE) / SCALE
    return out.reshape(rank, wide)[:, : len(terms)]


def _sum_rows(at: np.ndarray, parts: np.ndarray | dict[int, np.ndarray], most: int = 1024) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(at), most):
        own = at[k : k + most]
        values = pa.array(np.concatenate([parts[int(x)] for x in own]))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * PIECE, pa.int32()), values)], names=["at", "sums"])


def _add_passages(total: np.ndarray, h: np.ndarray, doc: np.ndarray, idf: np.ndarray, squares: np.ndarray, column: np.ndarray) -> None:
    """Adds each passage's row, its length made 1, to a sum that is hashed, with a hashed sign."""
    t, starts = _terms(h), _block_starts(doc)
    sizes, pair = np.diff(np.append(starts, len(h))), np.append(doc[starts[1:]] == doc[starts[:-1]], False)
    length = np.sqrt(np.maximum(_passages(np.add.reduceat(squares[t], starts), pair), np.float32(1e-12)))
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    own = np.searchsorted(first, starts, side="right") - 1
    mix = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        key = mix(mix(np.add.reduceat(h, first)[own] + mix((starts - first[own]).astype(np.uint64))))
    sums = ((key >> np.uint64(8)) % np.uint64(len(total))).astype(np.int64) * total.shape[1]
    weight = np.where(key >> np.uint64(63), -SCALE, SCALE) / length
    known = np.flatnonzero(column[t] >= 0)
    at, value, block = column[t[known]], idf[t[known]], np.repeat(np.arange(len(starts)), sizes)[known]
    np.add.at(total.reshape(-1), sums[block] + at, np.rint(value * weight[block]).astype(np.int64))
    second = np.flatnonzero(np.append(False, pair[:-1])[block])  # words of a block that is also the second of the passage before
    before = block[second] - 1
    np.add.at(total.reshape(-1), sums[before] + at[second], np.rint(value[second] * weight[before]).astype(np.int64))


def _statistics(documents: DataFrame, benchmark: DataFrame) -> tuple[np.ndarray, list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(idf, passages whose words have vectors too, (terms, sums of all passages over them))."""
    idf, passages = corpus_statistics(documents)
    terms = np.unique(np.concatenate([benchmark_terms(benchmark), *passages]))
    return idf, passages, (terms, passage_sums(documents, idf, terms))


def _block_starts(doc: np.ndarray) -> np.ndarray:
    """Word positions at which blocks begin: every BLOCK words of a document."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    blocks = -(-np.diff(np.concatenate([first, [len(doc)]])) // BLOCK)
    return np.repeat(first - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(blocks.sum())


def latent_space(items: list[Item], windows: list[tuple[int, int]], idf: np.ndarray, passages: list[np.ndarray], sums: tuple[np.ndarray, np.ndarray] | None, rank: int = RANK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row of each hashed term or 0, word vectors with row 0 empty) of the items' windows and the sums of all passages of the documents.

    Words of the windows and of as many ``passages`` have vectors. Sums are added up to as many as there are windows at most. Without
    sums the passages themselves are taken.

    Randomised singular value decomposition of the passage-by-term matrix A (rows of length 1, so that light items count): the range of A' (A A') W for a random W, then the
    decomposition of A inside it, cut to its ``rank`` greatest directions. A word's vector is its idf times its row of right singular vectors.
    """
    spans = [*(_terms(items[i].words[s : s + 2 * BLOCK]) for i, s in windows), *passages[: len(windows)]]
    terms = np.unique(np.concatenate(spans))
    row = np.zeros(TERMS, np.int32)
    row[terms] = np.arange(1, len(terms) + 1)
    spans = spans if sums is None else spans[: len(windows)]
    a = np.zeros((len(spans), len(terms)), np.float32)
    for k, span in enumerate(spans):
        np.add.at(a[k], row[span] - 1, idf[span])
    if sums is not None:
        there = np.flatnonzero(row[sums[0]])
        own = np.zeros((min(len(windows), len(sums[1])), len(terms)), np.float32)
        for k, one in enumerate(sums[1]):
            own[k % len(own), row[sums[0][there]] - 1] += one[there]
        a = np.concatenate([a, own])
    a = _unit(a)
    width = min(rank + OVERSAMPLE, *a.shape)
    y = a @ (a.T @ np.random.default_rng(seed).normal(size=(len(a), width)).astype(np.float32))
    q, _ = np.linalg.qr(a.T @ y)
    _, _, right = np.linalg.svd(a @ q, full_matrices=False)
    vectors = (q @ right[:rank].T) * idf[terms, None]
    return row, np.concatenate([np.zeros((1, vectors.shape[1]), np.float32), vectors.astype(np.float32)])


def longest_common(masks: list[int], size: int) -> int:
    """Length of the longest common subsequence of an item of ``size`` words and a text, whose words that the item has stand for bit masks of their places there."""
    full = (1 << size) - 1
    state = full
    for mask in masks:
        both = state & mask
        state = ((state + both) | (state - both)) & full
    return size - state.bit_count()


class Places:
    """The different words of an item, how often each occurs, and where as a bit mask."""

    def __init__(self, words: np.ndarray) -> None:
        self.size = len(words)
        self.keys, own, self.counts = np.unique(words, return_inverse=True, return_counts=True)
        self.masks = [0] * len(self.keys)
        for i, k in enumerate(own.tolist()):
            self.masks[k] |= 1 << i

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the words that the item has, their numbers among its different words)."""
        k = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[k] == words)
        return at, k[at]

    def most(self, k: np.ndarray) -> int:
        """What no common subsequence exceeds: the words in common, in any order."""
        return int(np.minimum(np.bincount(k, minlength=len(self.keys)), self.counts).sum())

    def longest(self, k: np.ndarray) -> int:
        return longest_common([self.masks[x] for x in k.tolist()], self.size)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), np.float32(1e-12))


def _item_windows(items: list[Item]) -> list[tuple[int, int]]:
    """(item, first word) of the windows that stand for an item: two blocks long, one block apart, the last at its end."""
    out = []
    for i, item in enumerate(items):
        n = len(item.words)
        starts = list(range(0, max(n - 2 * BLOCK, 0) + 1, BLOCK))
        if n > 2 * BLOCK and starts[-1] != n - 2 * BLOCK:
            starts.append(n - 2 * BLOCK)
        out += [(i, s) for s in starts]
    return out


class Block:
    """Items of a benchmark with at most WINDOWS windows, and their latent space. Plain arrays; tasks derive the rest."""

    def __init__(self, items: list[Item], windows: list[tuple[int, int]], idf: np.ndarray, passages: list[np.ndarray] | None = None, sums: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.items, self.windows = items, windows
        self.row, self.vectors = latent_space(items, windows, idf, passages or [], sums)

    def size(self) -> int:
        return self.row.nbytes + self.vectors.nbytes + sum(x.words.nbytes + x.answer.nbytes for x in self.items)

    def prepare(self, idf: np.ndarray) -> None:
        spans = [_terms(self.items[i].words[s : s + 2 * BLOCK]) for i, s in self.windows]
        latent = np.stack([self.vectors[self.row[span]].sum(axis=0) for span in spans])
        self.lengths = np.sqrt((latent * latent).sum(axis=1))
        self.latent = _unit(latent).T.copy()
        self.inside = np.where(self.row > 0, idf, 0) ** 2
        # A passage that holds a share of a window has at least this sum of squares (a term counts as often as it occurs in both).
        self.light = min(LEAST_HELD * float(n) ** 2 / np.bincount(span).max() for n, span in zip(self.lengths, spans, strict=True))
        self.floor = LEAST_HELD * float(self.lengths.min())
        self.places, self.answers = [Places(x.words) for x in self.items], [Places(x.answer) for x in self.items]

    def fold(self, rows: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of the vectors of ``rows`` from each begin on: the first of all, then the second of those that have one, and so on."""
        order = np.argsort(-sizes, kind="stable")
        at, more = begin[order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)))
        sums, one = np.zeros((len(sizes), self.vectors.shape[1]), np.float32), np.empty((len(sizes), self.vectors.shape[1]), np.float32)
        for j, n in enumerate(more.tolist()):
            sums[:n] += np.take(self.vectors, rows[at[:n] + j], axis=0, out=one[:n], mode="clip")
        one[order] = sums
        return one


class Finder:
    """Finds the items of some blocks in texts."""

    def __init__(self, blocks: list[Block], idf: np.ndarray) -> None:
        self.blocks, self.squares, self.hasher = blocks, idf**2, WordHasher()
        for block in blocks:
            block.prepare(idf)

    def find(self, texts: list[bytes | None], least_cosine: float = LEAST_COSINE) -> dict[tuple[int, int, int], tuple[float, float, float]]:
        """(text, block, item) of what is found: cosine, overlap, answer."""
        out: dict[tuple[int, int, int], tuple[float, float, float]] = {}
        for a, b in slices(texts):
            h, doc = self.hasher.words(texts[a:b])
            if not len(h):
                continue
            t, starts = _terms(h), _block_starts(doc)
            ends = np.concatenate([starts[1:], [len(h)]])
            pair = np.concatenate([doc[starts[1:]] == doc[starts[:-1]], [False]])
            norm = np.maximum(_passages(np.add.reduceat(self.squares[t], starts), pair), np.float32(1e-12))
            for k, block in enumerate(self.blocks):
                for (d, i), found in self._in_block(block, h, doc, t, starts, ends, pair, norm, least_cosine).items():
                    out[a + d, k, i] = found
        return out

    def _in_block(self, block: Block, h: np.ndarray, doc: np.ndarray, t: np.ndarray, starts: np.ndarray, ends: np.ndarray, pair: np.ndarray, norm: np.ndarray, least_cosine: float) -> dict[tuple[int, int], tuple]:
        # No cosine can exceed the share of a passage's weight that the block's words hold.
        held = _passages(np.add.reduceat(block.inside[t], starts), pair)
        able = np.flatnonzero(held >= np.minimum(least_cosine**2 * norm, block.light))
        best: dict[tuple[int, int], tuple] = {}
        compared: set[tuple[int, int, int, bool]] = set()
        rows = block.row[t]
        known = np.flatnonzero(rows)
        rows = rows[known]
        first, last = np.searchsorted(known, starts), np.searchsorted(known, ends)
        for at in range(0, len(able), PART):
            part = able[at : at + PART]
            # Each block of words is folded once, by those of its words that the items have.
            need = np.unique(np.concatenate([part, part[pair[part]] + 1]))
            folded = block.fold(rows, first[need], last[need] - first[need])
            z = folded[np.searchsorted(need, part)]
            z[pair[part]] += folded[np.searchsorted(need, part[pair[part]] + 1)]
            inner = np.sqrt((z * z).sum(axis=1))
            longer = np.maximum(inner, np.sqrt(norm[part]))
            # No product with a direction exceeds the length in the space; the slack is for rounding.
            least = np.minimum(least_cosine * longer, block.floor) * np.float32(1 - 1e-4)
            left = np.flatnonzero(inner >= least)
            dots = z[left] @ block.latent
            high = np.flatnonzero(dots.max(axis=1, initial=0) >= least[left])
            dots, left = dots[high], left[high]
            cosines = dots / longer[left, None]
            for p, w in zip(*np.nonzero((cosines >= least_cosine) | (dots >= LEAST_HELD * block.lengths)), strict=True):
                start, (i, lead), cosine = int(starts[part[left[p]]]), block.windows[w], float(dots[p, w] / max(inner[left[p]], 1e-12))
                asked = i, int(doc[start]), start - lead, cosine < least_cosine
                if asked not in compared:
                    compared.add(asked)
                    _compare(best, block, (i, lead), h, doc, start, cosine, asked[3])
        return best


def _passages(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Sums over a block of words and, in the same document, the next."""
    out = x.copy()
    out[:-1][pair[:-1]] += x[1:][pair[:-1]]
    return out


def _passes(benchmark: DataFrame, statistics: Callable[[], tuple[np.ndarray, list[np.ndarray], tuple[np.ndarray, np.ndarray]]]) -> Iterator[list[Block]]:
    """The benchmark's blocks, in lists of bounded size. Rows come to the driver one by one."""
    own, size = [], 0
    given = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    for items, windows in _blocks(x for r in given.toLocalIterator() for x in _items([r])):
        block = Block(items, windows, *statistics())
        if own and size + block.size() > PASS_BYTES:
            yield own
            own, size = [], 0
        own.append(block)
        size += block.size()
    if own:
        yield own


def _compare(best: dict, block: Block, window: tuple[int, int], h: np.ndarray, doc: np.ndarray, start: int, cosine: float, close: bool = False) -> None:
    """Checks one candidate word by word where the item would stand in the document; keeps the best of each document and item.

    ``close``: the passage is not like the item but may hold it; the words must then stand within half as many again as the
    item's, and an answer of one or two words proves nothing.
    """
    i, first = window
    item, places, answers, d = block.items[i], block.places[i], block.answers[i], int(doc[start])
    n = len(item.words)
    if (d, i) in best and best[d, i][1] >= 1:
        return
    lo, hi = max(start - first - _SLACK - BLOCK, 0), min(start - first + n + _SLACK + BLOCK, len(h))
    words = h[lo:hi][doc[lo:hi] == d]
    at, k = places.of(words)
    if places.most(k) / n < LIKELY:
        return
    share = places.longest(k) / n
    if share < LIKELY:
        return
    for begin in at.tolist() if close else [0]:
        end = begin + n + n // 2 if close else len(words)
        if close:
            a, b = np.searchsorted(at, (begin, end))
            share = (b - a) / n
            if share < LIKELY:
                continue
            share = places.longest(k[a:b]) / n
        if share < LIKELY:
            continue
        answer = answers.longest(answers.of(words[begin:end])[1]) / max(len(item.answer), 1)
        if (share >= SURE or (answer >= ANSWER and (not close or len(item.answer) > 2))) and ((d, i) not in best or share > best[d, i][1]):
            best[d, i] = (cosine, share, answer)


def _items(rows: list) -> list[Item]:
    hasher, out = WordHasher(), []
    for r in rows:
        words, answer = (hasher.words([t.encode("utf-8", "replace")])[0] for t in (r["text"], answer_of(r["text"])))
        if len(words):
            out.append(Item(r["item_id"], words, answer if len(answer) else words))
    return out


def _blocks(items: Iterator[Item], most: int = WINDOWS) -> Iterator[tuple[list[Item], list[tuple[int, int]]]]:
    """Items and their windows, in blocks of at most ``most`` windows; a longer item is in several."""
    own: list[Item] = []
    windows: list[tuple[int, int]] = []
    for item in items:
        for _, start in _item_windows([item]):
            if len(windows) == most:
                yield own, windows
                own, windows = [], []
            if not own or own[-1] is not item:
                own.append(item)
            windows.append((len(own) - 1, start))
    if windows:
        yield own, windows


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a contaminated document and benchmark item: doc_id, item_id, cosine, overlap, answer.

    Null or wordless texts and items match nothing; an item shorter than a passage is found inside passages, even one of a
    single word: short items call for a benchmark without them where that is not wanted. Repeated
    documents are all found; rows that share a doc_id (or have none) give one row an item. Clean documents give no row.
    """
    spark = documents.sparkSession
    statistics = cache(lambda: _statistics(documents, benchmark))
    out = spark.createDataFrame([], "doc_id long, item_id long, cosine double, overlap double, answer double")
    for blocks in _passes(benchmark, statistics):
        given = spark.sparkContext.broadcast((blocks, statistics()[0]))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            finder = Finder(*given.value)
            for batch in batches:
                ids, found = batch.column(0), finder.find(batch.column(1).to_pylist())
                rows = [(ids[d].as_py(), finder.blocks[k].items[i].item_id, *values) for (d, k, i), values in found.items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "cosine", "overlap", "answer"])

        texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
        out = out.unionByName(texts.mapInArrow(run, out.schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"), F.max("answer").alias("answer"))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the contaminated rows. Each row is judged by its own text, whatever its doc_id, so no rows are joined."""
    spark, at = documents.sparkSession, len(documents.columns)
    statistics, source = cache(lambda given=documents: _statistics(given, benchmark)), documents
    for blocks in _passes(benchmark, statistics):
        given = spark.sparkContext.broadcast((blocks, statistics()[0]))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            finder = Finder(*given.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, _, _ in finder.find(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean)).select(range(at))

        documents = documents.select("*", F.col("text").cast("binary").alias("__passages")).mapInArrow(run, source.schema)
    return documents
