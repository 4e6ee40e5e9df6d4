"""Near-duplicate removal: candidates by SimHash, verified by the similarity of five-word shingles, one row of each group kept.

The fingerprint is of a document's distinct words, which small edits change least; documents whose fingerprints lie close are
only candidates. A candidate pair is linked if the sketches of its shingles agree: the share of equal minima estimates the
Jaccard similarity with a standard error of 0.025 at 0.8 (a byte of each minimum is kept; bytes agree by chance in one of 256). So documents that share words, an opening or a repeated word, but
few shingles, are never dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import append_columns, written
from ragloom.llm.components import connected_components
from ragloom.llm.simhash import BUCKET_COMPARISONS, SEED, TILE, _bucket_pairs, _with_keys, allocate, bit_correlations, block_distances, correlated_order

#: Words of a shingle, minima of a sketch, bits that candidates' fingerprints may differ in.
SHINGLE, MINIMA, DISTANCE = 5, 256, 6
#: Estimated similarity from which on a pair is linked: just over one standard error under 0.8, so that most pairs of 0.8 are found.
LEAST = 0.77
_PART = 1 << 15
_draw = np.random.default_rng(7)
_FACTORS = _draw.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _draw.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_PLACES = _draw.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(text: str | None) -> tuple[int, bytes]:
    """(SimHash of the distinct words, signed; sketch of the shingles). Texts without words have zeros; fewer words than a shingle's are
    one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0, bytes(MINIMA)
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), np.uint64, len(words))
    distinct = np.unique(w)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(distinct), _PART):
        ones += np.unpackbits(distinct[at : at + _PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(2 * ones > len(distinct), bitorder="little").view("<i8")[0])
    size = min(SHINGLE, len(w))
    with np.errstate(over="ignore"):
        shingles = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k] * _PLACES[k]
        shingles ^= shingles >> np.uint64(29)
        shingles = np.unique(shingles)
        least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 512):
            least = np.minimum(least, (shingles[at : at + 512, None] * _FACTORS + _TERMS).min(axis=0))
    return fp, (least >> np.uint64(32)).astype(np.uint8).tobytes()


def with_signatures(documents: DataFrame, keep: list[str]) -> DataFrame:
    """documents with fp, sketch and node: a number that documents with the same fp and sketch share."""
    signed = append_columns(documents, ["text"], [T.StructField("fp", T.LongType()), T.StructField("sketch", T.BinaryType())], lambda: lambda texts: list(map(list, zip(*map(signature, texts)))) or [[], []], keep)
    return signed.withColumn("node", F.xxhash64("fp", "sketch"))


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) >= LEAST


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), MINIMA)


def _close_rows(tile: pa.Table, distance: int) -> pa.Table:
    """The rows of a tile whose fingerprint lies within the distance of another node's on the other side."""
    fp, node, side = (tile[c].to_numpy() for c in ("fp", "node", "side"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    near = np.bitwise_count(fp[left].view(np.uint64)[:, None] ^ fp[right].view(np.uint64)[None, :]) <= distance
    near &= node[left][:, None] != node[right][None, :]
    return tile.take(np.sort(np.concatenate([left[near.any(axis=1)], right[near.any(axis=0)]])))


def _tile_links(frame: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links of two sides of a tile: each node to the smallest of its connected piece there, by verified pairs. At most a row a node."""
    sides = [frame[frame["side"] == s].drop_duplicates("node").sort_values("node") for s in (0, 1)]
    if not len(sides[0]) or not len(sides[1]):
        return pd.DataFrame({"src": [], "dst": []}).astype("int64")
    (left, right), (a_fp, b_fp) = ([s["node"].to_numpy() for s in sides], [s["fp"].to_numpy().view(np.uint64) for s in sides])
    a_sketch, b_sketch = (_sketches(s["sketch"]) for s in sides)
    rows, columns = np.nonzero(np.bitwise_count(a_fp[:, None] ^ b_fp[None, :]) <= distance)
    near = np.zeros((len(left), len(right)), bool)
    for at in range(0, len(rows), _PART):
        i, j = rows[at : at + _PART], columns[at : at + _PART]
        near[i, j] = _similar(a_sketch[i], b_sketch[j])
    a, b, top = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(near, b[None, :], top).min(axis=1))
        new_b = np.minimum(b, np.where(near, new_a[:, None], top).min(axis=0))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    src, dst = np.concatenate([left, right]), np.concatenate([a, b])
    return pd.DataFrame({"src": src[src != dst], "dst": dst[src != dst]})


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_similar(_sketches(a), _sketches(b)) if len(a) else np.zeros(0, bool))


def close_tiles(keys: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """(part, key, near, i, j, fp, node, side): the rows of the tiles of these bucket pairs that have a close fingerprint opposite.

    Only fingerprints meet here. In how many pairs of buckets a row stands grows with the buckets; in how many of them it is close to
    another does not, so what is left grows with the pairs that are close, and at most a row a node and tile.
    """
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    tile_of = lambda n: F.pmod(F.xxhash64("node"), tiles(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), tiles(n) - 1))
    at = lambda side, i, j, number: side.select("part", "key", "near", i.alias("i"), j.alias("j"), "fp", "node", F.lit(number).alias("side"))
    side0 = at(pairs.join(keys, ["part", "key"]), tile_of("n"), every("n_near"), 0)
    side1 = at(pairs.join(keys.withColumnRenamed("key", "near"), ["part", "near"]), every("n"), tile_of("n_near"), 1)
    tiled = side0.unionByName(side1).where("key != near or i <= j")
    return tiled.groupBy("part", "key", "near", "i", "j").applyInArrow(lambda tile: _close_rows(tile, distance), tiled.schema)


def verified_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(src, dst) edges over nodes (node, fp, sketch; a written table) whose components are those of all verified pairs.

    Pairs of small buckets are compared one by one, their sketches joined after the fingerprints have been compared. Pairs of large
    buckets go to tiles of bounded size: first the fingerprints alone, then, of rows with a close one, the sketches. Tiles give linking
    edges only.
    """
    rows = nodes.count()
    if rows < 2:
        return nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)
    order = correlated_order(bit_correlations(nodes.select("fp")))
    parts = allocate(block_distances(nodes.select("fp"), order, distance), rows, distance)
    keys = written(_with_keys(nodes, order, parts, ["node"]), "neardup-keys")
    pairs = written(_bucket_pairs(keys, parts).where("key != near or n > 1"), "neardup-buckets")
    size = F.col("n") * F.col("n_near")
    left = keys.withColumnsRenamed({"fp": "src_fp", "node": "src"})
    right = keys.select("part", F.col("key").alias("near"), F.col("fp").alias("dst_fp"), F.col("node").alias("dst"))
    light = pairs.where(size <= BUCKET_COMPARISONS).select("part", "key", "near")
    close = light.join(left, ["part", "key"]).join(right, ["part", "near"]).where((F.bit_count(F.col("src_fp").bitwiseXOR(F.col("dst_fp"))) <= distance) & (F.col("src") != F.col("dst")))
    candidates = close.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    sketch = lambda name: nodes.select(F.col("node").alias(name), F.col("sketch").alias(f"{name}_sketch"))
    found = candidates.join(sketch("src"), "src").join(sketch("dst"), "dst").where(_alike("src_sketch", "dst_sketch")).select("src", "dst")
    tiled = close_tiles(keys, pairs.where(size > BUCKET_COMPARISONS), distance).join(nodes.select("node", "sketch"), "node")
    return found.unionByName(tiled.groupBy("part", "key", "near", "i", "j").applyInPandas(lambda frame: _tile_links(frame, distance), "src long, dst long"))


def deduplicated(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """documents with one row of each group of near duplicates: that with the smallest doc_id (null last), of equals the first read.

    A group is what verified links join, directly or through others. Rows are told apart by their place, not by doc_id: repeated
    rows and rows without doc_id are judged like any other. Null and empty texts, and texts of white space, form one group.
    """
    names = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text").withColumn("place", F.monotonically_increasing_id())
    docs = written(with_signatures(rows, ["row", "doc_id", "place"]), "signatures")
    order: Column = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    nodes = written(docs.groupBy("node").agg(F.min(order).alias("first"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch")), "signature-nodes")
    members = connected_components(verified_links(nodes.select("node", "fp", "sketch"), distance))
    heads = nodes.select("node", "first").join(members, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    return docs.join(heads.select("first.place"), "place", "left_semi").select("row.*")
