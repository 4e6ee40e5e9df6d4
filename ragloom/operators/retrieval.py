"""Exact cosine retrieval: filters before scores, top k for one query or many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions import text as texts
from ragloom.functions.vectors import cosine, norm

#: Bytes of the vectors of one block, of points or of queries.
BLOCK_BYTES = 16 << 20
#: Payload columns that a search may filter by.
FILTERS = ("domain", "documentId", "chunkType", "sourcePath", "label")


class RetrievalError(ValueError):
    """A query or its settings cannot be served."""


def payload_filter(**wanted) -> Column:
    """Conjunction of equalities; fields that are None do not restrict."""
    unknown = set(wanted) - set(FILTERS)
    if unknown:
        raise RetrievalError(f"no such payload field: {', '.join(sorted(unknown))}")
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def top_k_limit(top_k: int | None, default: int = 10, most: int = 100) -> int:
    k = default if top_k is None else top_k
    if k > most:
        raise RetrievalError(f"top_k {k} is over the ceiling of {most}")
    return k


def valid_question(question: object, most: int = 2000) -> str:
    """The trimmed question; its raw length is checked first."""
    if not isinstance(question, str):
        raise RetrievalError("the question must be text")
    if len(question.encode("utf-16-le")) // 2 > most:
        raise RetrievalError(f"the question is over {most} characters")
    if not question.strip():
        raise RetrievalError("the question is empty")
    return question.strip()


def question_reason(question: Column, most: int = 2000) -> Column:
    """Why a question in a batch is refused, or null."""
    return F.when(question.isNull(), "missing").when(texts.utf16_length(question) > most, "too long").when(texts.trim(question) == "", "empty")


def top_k(points: DataFrame, query: list[float], k: int, where: Column | None = None, threshold: float | None = None, key: str = "id") -> DataFrame:
    """The k points most similar to one vector, with score; ties go to the smaller key. Points may bring their stored norm."""
    found = points if where is None else points.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    own = F.col("norm") if "norm" in points.columns else norm(F.col("vector"))
    scored = found.withColumn("score", cosine(F.col("vector"), q, own, F.lit(sum(x * x for x in query) ** 0.5)))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), key).limit(k)


def batch_top_k(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, key: str = "id") -> DataFrame:
    """(queryId, key, score, rank) of the k best points of every query (queryId, queryVector).

    A blocked product of two tables: points and queries are both dealt to blocks of bounded bytes, each block of the one meets each of
    the other in a cell of its own (points travel once a query block, queries once a point block), a cell is one matrix product that
    keeps k points a query, and only these are merged. Neither side is collected or broadcast. Scores are rounded to 12 places, so that
    equal vectors tie (for the smaller key) however they are dealt. Vectors of another size than the query's never meet it; rows
    without key or queryId, and vectors with nulls, are left out; a zero vector scores 0.
    """
    left = _usable(points, key, "vector", "point")
    right = _usable(queries, "queryId", "queryVector", "query")
    rows, columns = _blocks(left, "point"), _blocks(right, "query")
    block_of = lambda name, blocks: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    left = left.withColumns({"row": block_of(key, rows), "column": F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))})
    right = right.withColumns({"column": block_of("queryId", columns), "row": F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))})
    schema = T.StructType([queries.schema["queryId"], points.schema[key], T.StructField("score", T.DoubleType())])
    cells = left.groupBy("size", "row", "column").cogroup(right.groupBy("size", "row", "column")).applyInPandas(lambda p, q: nearest(p, q, k, threshold, key)[schema.fieldNames()], schema)
    return ranked(cells, k, key)


def ranked(candidates: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best of each query's candidates with rank. Spark cuts each task's rows to k a query before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("queryId").orderBy(F.desc("score"), key))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k)


def _usable(df: DataFrame, key: str, vector: str, name: str, more: list[str] | None = None) -> DataFrame:
    """(key, name, more columns, size) with the vector as doubles, of rows that have a key and a whole vector."""
    made = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(name), *(more or []))
    return made.where(~F.exists(name, lambda v: v.isNull())).withColumn("size", F.size(name))


def _blocks(df: DataFrame, name: str) -> int:
    """Number of blocks of about BLOCK_BYTES that hold the table's vectors."""
    numbers = df.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]
    return max(1, -(-8 * numbers // BLOCK_BYTES))


def nearest(points: pd.DataFrame, queries: pd.DataFrame, k: int, threshold: float | None, key: str) -> pd.DataFrame:
    """(queryId, key, score) of the k best points of each query within one cell, by matrix products of at most 256 queries."""
    found = []
    if len(points) and len(queries):
        points = points.sort_values(key, kind="stable")  # so that ties go to the smaller key
        x, keys = _unit_rows(points["point"]), points[key].to_numpy()
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            scores = np.round(_unit_rows(part["query"]) @ x.T, 12)
            least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(part), -np.inf)
            q, row = np.nonzero(scores >= (least if threshold is None else np.maximum(least, threshold))[:, None])
            best = pd.DataFrame({"q": q, key: keys[row], "score": scores[q, row]}).sort_values(["q", "score"], ascending=[True, False], kind="stable").groupby("q").head(k)
            found.append(best.assign(queryId=part["queryId"].to_numpy()[best["q"].to_numpy()]))
    if not found:
        return pd.DataFrame({"queryId": queries["queryId"].iloc[:0], key: points[key].iloc[:0], "score": np.zeros(0)})
    return pd.concat(found)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def results(matches: DataFrame, expand_parents: bool = True) -> DataFrame:
    """Matches as results: the parent's text only where expansion is on."""
    return matches.withColumn("parentText", F.when(F.lit(expand_parents), F.col("parentText")))
