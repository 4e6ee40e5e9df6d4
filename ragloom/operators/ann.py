"""Approximate search: inverted lists around centroids, with the number of lists to probe measured against exact search.

The centroids are fitted on a bounded sample; every point is put into the list of its nearest one. A query looks into its nearest
lists only. How many these must be for a wanted recall is read off exact results of a sample of queries, so recall is measured, not
assumed; ``probes=None`` searches exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.operators import retrieval
from ragloom.operators.retrieval import RetrievalError, batch_top_k, nearest, ranked

#: The centroids are fitted on so many points at most, of so many bytes: those whose ids hash lowest, wherever they stand.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: Lists of an index at most (their centroids go to every task).
MOST_LISTS = 4096
#: Queries whose exact results tell how many lists to probe.
TUNING_QUERIES = 200


def fit_centroids(points: DataFrame, lists: int, key: str = "id", vector: str = "vector", rounds: int = 12) -> np.ndarray:
    """Unit centroids (at most ``lists``) of the sample's directions, by k-means with cosine similarity from spread-out seeds."""
    size = points.agg(F.max(F.size(vector))).first()[0] or 0
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // max(8 * size, 1)))
    usable = retrieval._usable(points, key, vector, "point").where(F.col("size") == size)
    sample = usable.withColumn("h", F.xxhash64(key)).orderBy("h", key).limit(rows).select("point").toPandas()
    if not len(sample):
        return np.zeros((0, size))
    x = retrieval._unit_rows(sample["point"])
    draw = np.random.default_rng(1)
    centres = x[[0]]
    gap = 1 - x @ centres[0]
    while len(centres) < min(lists, len(x)) and gap.max() > 1e-9:
        chosen = draw.choice(len(x), p=np.maximum(gap, 0) / np.maximum(gap, 0).sum())
        centres = np.vstack([centres, x[chosen]])
        gap = np.minimum(gap, 1 - x @ x[chosen])
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


@dataclass
class Index:
    """Points with their lists (a stored table: list, key and the points' columns), the centroids and the number of lists to probe."""

    points: DataFrame
    centroids: np.ndarray
    key: str
    vector: str
    probes: int | None

    def search(self, queries: DataFrame, k: int, threshold: float | None = None, exact: bool = False) -> DataFrame:
        """(queryId, key, score, rank), as ``batch_top_k`` gives them, of the points in the lists probed; all of them where ``exact``."""
        if exact or self.probes is None or self.probes >= len(self.centroids):
            return batch_top_k(self.points.withColumnRenamed(self.vector, "vector") if self.vector != "vector" else self.points, queries, k, threshold, self.key)
        left = retrieval._usable(self.points, self.key, self.vector, "point", ["list"])
        right = self._probed(retrieval._usable(queries, "queryId", "queryVector", "query"), self.probes).where(F.col("place") < self.probes)
        # A list, and the queries that probe it, are cut into blocks of bounded bytes; there are at most MOST_LISTS counts a side.
        cuts = lambda df, name: F.broadcast(df.groupBy("list").agg(F.ceil(8 * F.sum(F.col("size").cast("long")) / retrieval.BLOCK_BYTES).cast("int").alias(name)))
        blocks = cuts(left, "rows").join(cuts(right, "columns"), "list")
        block_of = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = left.join(F.broadcast(blocks), "list").withColumns({"row": block_of(self.key, "rows"), "column": every("columns")}).drop("rows", "columns")
        right = right.join(F.broadcast(blocks), "list").withColumns({"column": block_of("queryId", "columns"), "row": every("rows")}).drop("rows", "columns", "place")
        schema = T.StructType([queries.schema["queryId"], self.points.schema[self.key], T.StructField("score", T.DoubleType())])
        key = self.key
        cell = ["size", "list", "row", "column"]
        found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(lambda p, q: nearest(p, q, k, threshold, key)[schema.fieldNames()], schema)
        return ranked(found, k, self.key)

    def _probed(self, queries: DataFrame, most: int) -> DataFrame:
        """A row for each query and each of its ``most`` nearest lists, with the list's place (0 first)."""
        return _nearest_lists(queries, "query", self.centroids, most)

    def needed_probes(self, queries: DataFrame, k: int, recall: float) -> int:
        """Lists that must be probed so that the k exact results of these queries are found with this recall."""
        exact = batch_top_k(self.points.select(self.key, F.col(self.vector).alias("vector")), queries, k, key=self.key)
        pairs = exact.join(self.points.select(self.key, "list"), self.key).select("queryId", "list")
        placed = self._probed(retrieval._usable(queries, "queryId", "queryVector", "query"), len(self.centroids)).select("queryId", "list", "place")
        counts = {r["place"]: r["n"] for r in pairs.join(placed, ["queryId", "list"]).groupBy("place").agg(F.count("*").alias("n")).collect()}  # at most a row a list
        total, found = sum(counts.values()), 0
        for place in sorted(counts):
            found += counts[place]
            if found >= recall * total:
                return place + 1
        return 1


def _nearest_lists(df: DataFrame, vector: str, centroids: np.ndarray, most: int) -> DataFrame:
    """df exploded to its rows' ``most`` nearest lists (list, place). Vectors of another size than the centroids' get list 0."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("place", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_LISTS rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                fits = part[vector].map(len) == centres.shape[1]
                for same, rows in part.groupby(fits):
                    if same:
                        scores = np.round(retrieval._unit_rows(rows[vector]) @ centres.T, 12)
                        lists = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                    else:
                        lists = np.zeros((len(rows), 1), np.int64)
                    out = rows.loc[rows.index.repeat(lists.shape[1])].copy()
                    out["list"], out["place"] = lists.ravel().astype(np.int32), np.tile(np.arange(lists.shape[1], dtype=np.int32), len(rows))
                    yield out[[*names, "list", "place"]]

    return df.mapInPandas(run, schema)


def build(spark: SparkSession, points: DataFrame, path: str, lists: int | None = None, recall: float = 0.9, k: int = 10, key: str = "id", vector: str = "vector") -> Index:
    """Writes the index of all points with a key and a whole vector below ``path`` and opens it.

    ``lists`` is the root of the number of points unless given. The points lie in order of their lists, so that a search reads few of the
    files' row groups. Probes are those that ``recall`` at k needs for TUNING_QUERIES points taken as queries.
    """
    usable = points.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(~F.exists(vector, lambda v: v.isNull()))
    lists = min(MOST_LISTS, max(1, round(usable.count() ** 0.5)) if lists is None else lists)
    if lists < 1:
        raise RetrievalError("an index needs at least one list")
    centroids = fit_centroids(usable, lists, key, vector)
    if len(centroids):
        assigned = _nearest_lists(usable, vector, centroids, 1).drop("place")
        assigned.repartitionByRange("list", key).sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/points")
        rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    else:
        usable.withColumn("list", F.lit(0)).write.mode("overwrite").parquet(f"{path}/points")
        rows = []
    index = Index(spark.read.parquet(f"{path}/points"), centroids, key, vector, None)
    queries = usable.withColumn("h", F.xxhash64(F.lit(1), key)).orderBy("h", key).limit(TUNING_QUERIES).select(F.col(key).alias("queryId"), F.col(vector).alias("queryVector"))
    index.probes = index.needed_probes(queries, k, min(1.0, recall + (1 - recall) / 2)) if rows else None  # half way to all, as other queries may fare worse
    spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(key, vector, index.probes)], "key string, vector string, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    """The index that ``build`` has written below a path."""
    settings = spark.read.parquet(f"{path}/settings").first()
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return Index(spark.read.parquet(f"{path}/points"), np.array([r["centroid"] for r in rows]), settings["key"], settings["vector"], settings["probes"])


def recall(found: DataFrame, exact: DataFrame, key: str = "id") -> float:
    """Share of the exact pairs of query and point that were found."""
    total = exact.count()
    return exact.join(found.select("queryId", key), ["queryId", key], "left_semi").count() / total if total else 1.0
