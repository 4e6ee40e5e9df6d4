"""SimHash near-duplicates: fingerprints, links within a Hamming distance by the generalised pigeonhole principle, components.

The 64 bits are ordered so that correlated bits stand together and are cut into parts. A dynamic programme gives each part a
threshold of its own (perhaps none) from the estimated number of candidates; two fingerprints within the distance agree on at
least one part up to its threshold. Parts are probed by their values, and candidates verified in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import append_columns, written
from ragloom.llm.components import connected_components

SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 4, distinct: bool = False) -> int:
    """Signed 64-bit SimHash of the word shingles (XXH64, seed 42); zero without words. Repeats count unless ``distinct``."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, last = b" ".join(words), max(len(words) - shingle, 0)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: last + 1].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    ones, counted, seen = np.zeros(64, np.int64), 0, set()
    for at in range(0, len(starts), _CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], dtype="<u8")
        if distinct:
            new = set(hashes.tolist()) - seen
            seen |= new
            hashes = np.array(list(new), dtype="<u8")
        counted += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > counted, bitorder="little").view("<i8")[0])


def with_fingerprints(documents: DataFrame, keep: list[str] | None = None, shingle: int = 4, distinct: bool = False) -> DataFrame:
    """documents with fp (signed 64-bit)."""
    return append_columns(documents, ["text"], [T.StructField("fp", T.LongType())], lambda: lambda texts: [[fingerprint(t, shingle, distinct) for t in texts]], keep)


#: Bits are grouped into so many blocks; parts are unions of neighbouring blocks.
_BLOCKS, _BLOCK = 8, 8
#: Work of one probe row against one verified candidate, for the choice of parts and thresholds.
_PROBE_COST, _CANDIDATE_COST = 4.0, 1.0
#: Pairs of buckets with more comparisons than this are compared in tiles, which give only linking edges.
BUCKET_COMPARISONS, TILE = 1 << 8, 1024


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlations(fps: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the fingerprint bits, from sums over all rows (of a fixed size a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for batch in batches:
            x = np.ones((batch.num_rows, 65), np.float32)
            x[:, :64] = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65), pa.int64()), pa.array(total.ravel())], names=["cell", "s"])

    cells = fps.select("fp").mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(65 * 65)
    for row in cells:
        total[row["cell"]] = row["s"]
    total = total.reshape(65, 65)
    n = max(total[64, 64], 1.0)
    mean = total[64, :64] / n
    cov = total[:64, :64] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return np.abs(cov / np.outer(spread, spread))


def correlated_order(corr: np.ndarray) -> list[int]:
    """Bit order in which each block of eight is filled greedily with the bits most correlated to those in it."""
    left, order = set(range(len(corr))), []
    while left:
        rest = sorted(left)
        pair = max(combinations(rest, 2), key=lambda p: corr[p]) if len(rest) > 1 else (rest[0],)
        block = list(pair)
        left -= set(block)
        while len(block) < _BLOCK and left:
            block.append(max(sorted(left), key=lambda b: corr[b, block].sum()))
            left.discard(block[-1])
        order += block
    return order


def block_distances(fps: DataFrame, order: list[int], most: int) -> np.ndarray:
    """For each block, the share of all pairs of rows at distance 0..most there: from exact value counts by xor-correlation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_BLOCKS, 256), np.int64)
        for batch in batches:
            values = np.packbits(_bits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))[:, order], axis=1, bitorder="little")
            for b in range(_BLOCKS):
                total[b] += np.bincount(values[:, b], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BLOCKS * 256), pa.int64()), pa.array(total.ravel())], names=["cell", "c"])

    counts = np.zeros(_BLOCKS * 256)
    for row in fps.select("fp").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect():
        counts[row["cell"]] = row["c"]
    ones = np.bitwise_count(np.arange(256, dtype=np.uint8))
    out = np.zeros((_BLOCKS, most + 1))
    for b, h in enumerate(counts.reshape(_BLOCKS, 256)):
        w = h.copy()
        for step in (1, 2, 4, 8, 16, 32, 64, 128):  # Walsh-Hadamard transform
            w = w.reshape(-1, 2, step)
            w = np.stack([w[:, 0] + w[:, 1], w[:, 0] - w[:, 1]], axis=1).ravel()
        w = w * w
        for step in (1, 2, 4, 8, 16, 32, 64, 128):
            w = w.reshape(-1, 2, step)
            w = np.stack([w[:, 0] + w[:, 1], w[:, 0] - w[:, 1]], axis=1).ravel()
        pairs = np.bincount(ones, weights=w / 256, minlength=9)
        out[b] = pairs[: most + 1] / max(pairs.sum(), 1.0)
    return out


def allocate(block_shares: np.ndarray, rows: int, distance: int) -> list[tuple[int, int, int]]:
    """Parts (first block, blocks, threshold) of the cheapest split.

    A part's candidates are rows^2 times the share of pairs within its threshold (blocks taken as independent); its probes are
    half the values within the threshold. For every even split the dynamic programme spends distance + 1 in units of
    threshold + 1 over the parts, so that no pair within the distance escapes all of them.
    """
    best: tuple[float, list[tuple[int, int, int]]] | None = None
    for parts in range(min(2, distance + 1), distance + 2):
        cuts = [round(i * _BLOCKS / parts) for i in range(parts + 1)]
        cost = []
        for a, b in zip(cuts, cuts[1:]):
            shares = np.zeros(distance + 1)
            shares[0] = 1
            for block in block_shares[a:b]:
                shares = np.convolve(shares, block)[: distance + 1]
            width, line = (b - a) * _BLOCK, [0.0]
            for t in range(distance + 1):
                probes = rows * (1 + sum(math.comb(width, k) for k in range(1, t + 1)) / 2)
                line.append(_PROBE_COST * probes + _CANDIDATE_COST * rows * rows / 2 * shares[: t + 1].sum())
            cost.append(line)
        table = {0: (0.0, ())}
        for line in cost:
            following: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (total, chosen) in table.items():
                for units, price in enumerate(line):
                    at = spent + units
                    if at <= distance + 1 and (at not in following or total + price < following[at][0]):
                        following[at] = (total + price, (*chosen, units))
            table = following
        total, chosen = table[distance + 1]
        if best is None or total < best[0]:
            best = total, [(a, b - a, units - 1) for (a, b), units in zip(zip(cuts, cuts[1:]), chosen) if units]
    return best[1]


def _with_keys(fps: DataFrame, order: list[int], parts: list[tuple[int, int, int]], more: list[str] | None = None) -> DataFrame:
    """(part, key, fp) and more columns: the value of each part that has a threshold, made of its bits in order."""

    def key(first: int, blocks: int) -> Column:
        total = F.lit(0).cast("long")
        for place, bit in enumerate(order[first * _BLOCK : (first + blocks) * _BLOCK]):
            total = total.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), bit).bitwiseAND(F.lit(1).cast("long")), place))
        return total

    listed = F.array(*[F.struct(F.lit(i).alias("part"), key(a, n).alias("key")) for i, (a, n, _) in enumerate(parts)])
    return fps.select("fp", *(more or []), F.explode(listed).alias("k")).select("k.part", "k.key", "fp", *(more or []))


def _masks(width: int, threshold: int) -> list[int]:
    """Flips of 0..threshold bits."""
    return [sum(1 << b for b in bits) for n in range(threshold + 1) for bits in combinations(range(width), n)]


def _bucket_pairs(keys: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(part, key, near, n, n_near): occupied buckets within the part's threshold, each pair once, and each bucket with itself."""
    counted = keys.groupBy("part", "key").agg(F.count("*").alias("n"))
    flips = None
    for i, (_, blocks, threshold) in enumerate(parts):
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(blocks * _BLOCK, threshold)])
        flips = F.when(F.col("part") == i, masks) if flips is None else flips.when(F.col("part") == i, masks)
    # Only the smaller key of a pair probes: the highest flipped bit goes from 0 to 1. A long's sign bit is never part of a key under 64 bits.
    probes = counted.select("part", "key", "n", F.explode(F.transform(F.filter(flips, lambda m: F.col("key").bitwiseXOR(m) >= F.col("key")), lambda m: F.col("key").bitwiseXOR(m))).alias("near"))
    return probes.join(counted.select("part", F.col("key").alias("near"), F.col("n").alias("n_near")), ["part", "near"])


def _tile_edges(distance: int):
    """Within a tile pair: links every fingerprint to the smallest of its connected piece there. Emits at most a row a fingerprint."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left, right = (np.unique(frame["fp"].to_numpy()[frame["side"].to_numpy() == s]) for s in (0, 1))
        if not len(left) or not len(right):
            return pd.DataFrame({"src": [], "dst": []}).astype("int64")
        near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= distance
        a, b = left.copy(), right.copy()
        top = np.iinfo(np.int64).max
        while True:
            new_a = np.minimum(a, np.where(near, b[None, :], top).min(axis=1))
            new_b = np.minimum(b, np.where(near, new_a[:, None], top).min(axis=0))
            if (new_a == a).all() and (new_b == b).all():
                break
            a, b = new_a, new_b
        src, dst = np.concatenate([left, right]), np.concatenate([a, b])
        return pd.DataFrame({"src": src[src != dst], "dst": dst[src != dst]})

    return run


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(src, dst) edges over distinct fingerprints (column fp) whose components are those of all pairs within the distance."""
    rows = fps.count()
    if rows < 2:
        return fps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    order = correlated_order(bit_correlations(fps))
    parts = allocate(block_distances(fps, order, distance), rows, distance)
    keys = written(_with_keys(fps, order, parts), "simhash-keys")
    pairs = written(_bucket_pairs(keys, parts).where("key != near or n > 1"), "simhash-buckets")
    size = F.col("n") * F.col("n_near")
    left, right = keys.withColumnRenamed("fp", "src"), keys.select("part", F.col("key").alias("near"), F.col("fp").alias("dst"))
    light = pairs.where(size <= BUCKET_COMPARISONS).select("part", "key", "near")
    verified = light.join(left, ["part", "key"]).join(right, ["part", "near"])
    found = verified.where((F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance) & ((F.col("key") != F.col("near")) | (F.col("src") < F.col("dst")))).select("src", "dst")
    heavy = pairs.where(size > BUCKET_COMPARISONS)
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    tile_of = lambda fp, n: F.pmod(F.xxhash64(fp), tiles(n)).cast("int")
    side0 = heavy.join(left, ["part", "key"]).select("part", "key", "near", tile_of("src", "n").alias("i"), F.explode(F.sequence(F.lit(0), tiles("n_near") - 1)).alias("j"), F.col("src").alias("fp"), F.lit(0).alias("side"))
    side1 = heavy.join(right, ["part", "near"]).select("part", "key", "near", F.explode(F.sequence(F.lit(0), tiles("n") - 1)).alias("i"), tile_of("dst", "n_near").alias("j"), F.col("dst").alias("fp"), F.lit(1).alias("side"))
    tiled = side0.unionByName(side1).where("key != near or i <= j")
    return found.unionByName(tiled.groupBy("part", "key", "near", "i", "j").applyInPandas(_tile_edges(distance), "src long, dst long"))


def near_duplicates(documents: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Equal fingerprints are linked; null and empty texts have fingerprint zero and are linked like any other. A repeated
    doc_id keeps each of its rows; components are of fingerprints, so each row has the component of its own. A null doc_id is
    never the smallest.
    """
    docs = written(with_fingerprints(documents.select("doc_id", "text"), ["doc_id"], shingle), "fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    members = connected_components(links(fps.select("fp"), distance))
    joined = fps.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    # Written, so that the rows of a hot fingerprint can be split by the join that follows.
    by_fp = written(joined.join(least, "component").select("fp", "component_id"), "fingerprint-components")
    return docs.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

