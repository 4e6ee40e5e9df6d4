"""Chunks to embedding records: inputs, resumption, cap, batches, providers, accounting."""

from __future__ import annotations

import concurrent.futures
import inspect
import random
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions import folds, ids, text, vectors
from ragloom.sources import scratch


class FailureRatioExceeded(RuntimeError):
    """More rows failed than the threshold allows; what was written stays."""


class TransientProviderError(RuntimeError):
    """A call that may be repeated; ``retry_after_ms`` if the provider says when."""

    def __init__(self, message: str, retry_after_ms: float | None = None) -> None:
        super().__init__(message)
        self.retry_after_ms = retry_after_ms


def embedding_inputs(chunks: DataFrame, most_tokens: int = 8000, heading_context: bool = True) -> DataFrame:
    """chunks with input, inputHash, tokenCount, truncated; input is null where nothing is left to embed."""
    crumb = text.breadcrumb(F.col("headingPath"))
    raw = F.when(crumb != "", F.concat(crumb, F.lit("\n\n"), "text")).otherwise(F.col("text")) if heading_context else F.col("text")

    def described(cut: Column) -> Column:
        filled = F.nullif(cut["text"], F.lit(""))
        return F.struct(filled.alias("input"), cut["truncated"].alias("truncated"), ids.content_hash(filled).alias("inputHash"), text.token_estimate(filled).alias("tokenCount"))

    made = text.let(text.truncate_words(text.normalise_input(raw), most_tokens), described)
    # A generator of one row: what follows (filters too) uses its columns and never computes them again.
    return chunks.drop("input", "truncated", "inputHash", "tokenCount").select("*", F.inline(F.array(made)))


def with_embedding_ids(inputs: DataFrame, provider: str, model: str, version: str, dimensions: int) -> DataFrame:
    return inputs.withColumn("embeddingId", ids.embedding_id(F.col("chunkId"), F.col("contentHash"), F.lit(provider), F.lit(model), F.lit(version), F.lit(dimensions)))


def run_status(candidates: DataFrame, existing: DataFrame, chunk_types: list[str], cap: int = 0, order: list[str] | None = None) -> DataFrame:
    """candidates with status: skippedByType, skippedEmpty, alreadyEmbedded, skippedByCap or pending, tested in this order.

    The cap keeps the first ``cap`` pending rows in the order given (default documentId, sequenceIndex, chunkId), then of
    embeddingId; of rows that are equal in all these, as many as fit. With a cap the candidates are written once; the rows that it
    keeps are found by ranges (``first_rows``), whatever its size.
    """
    order = [*(order or ["documentId", "sequenceIndex", "chunkId"]), "embeddingId"]
    known = existing.select("embeddingId").distinct().withColumn("known", F.lit(True))
    df = candidates.join(known, "embeddingId", "left")
    status = F.when(~F.col("chunkType").isin(chunk_types), "skippedByType").when(F.col("input").isNull(), "skippedEmpty").when(F.col("known") | (F.col("repeated") if "repeated" in df.columns else F.lit(False)), "alreadyEmbedded").otherwise("pending")
    df = df.withColumn("status", status).drop("known", "repeated")
    if cap <= 0:
        return df
    df = scratch.written(df, "candidates")
    first = first_rows(df.where("status = 'pending'").select(*order), order, cap).groupBy(*order).agg(F.count("*").alias("within"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in order]
    joined = df.alias("d").join(first.alias("f"), same, "left").select("d.*", "f.within")
    # Rows that are equal in the whole order are counted; the others need no place.
    place = F.row_number().over(Window.partitionBy(*order, "status").orderBy(F.lit(1)))
    inside = joined.where("within is not null and status = 'pending'").withColumn("place", place)
    kept = F.when(F.col("place") > F.col("within"), "skippedByCap").otherwise(F.col("status"))
    outside = joined.where("not (within is not null and status = 'pending')").withColumn("status", F.when(F.col("status") == "pending", "skippedByCap").otherwise(F.col("status")))
    return inside.withColumn("status", kept).select(*df.columns).unionByName(outside.select(*df.columns))


def first_rows(keys: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows in the order: whole ranges as long as they fit, and of the range that holds the last row its first rows.

    Rows are dealt by ranges from sampled borders and counted; only the counts, a number a range, come to the driver. No more than
    one range is ever sorted in one place.
    """
    ranged = scratch.written(keys.repartitionByRange(*order).withColumn("split", F.spark_partition_id()), "ranges")
    counts = sorted((r["split"], r["n"]) for r in ranged.groupBy("split").agg(F.count("*").alias("n")).collect())
    before = 0
    for split, n in counts:
        if before + n >= cap:
            place = F.row_number().over(Window.partitionBy("split").orderBy(*order))
            last = ranged.where(F.col("split") == split).withColumn("place", place).where(F.col("place") <= cap - before).drop("place")
            return ranged.where(F.col("split") < split).unionByName(last).drop("split")
        before += n
    return ranged.drop("split")


def once(candidates: DataFrame, chunk_types: list[str]) -> DataFrame:
    """candidates with repeated: true for all but one row of each embeddingId among those of the chunk types with an input."""
    may = F.coalesce(F.col("chunkType").isin(chunk_types) & F.col("input").isNotNull(), F.lit(False))
    place = F.row_number().over(Window.partitionBy("embeddingId").orderBy(may.desc()))
    return candidates.withColumn("repeated", may & (place > 1))


def counts(status: Column) -> list[Column]:
    """Counts of a run's statuses; scanned is their sum."""
    kinds = ["skippedByType", "skippedEmpty", "alreadyEmbedded", "skippedByCap", "pending"]
    return [F.count(F.lit(1)).alias("scanned"), *[F.count_if(status == k).alias("attempted" if k == "pending" else k) for k in kinds]]


def accounting(statuses: DataFrame) -> DataFrame:
    """One row of counts; scanned is their sum."""
    return statuses.agg(*counts(F.col("status")))


def batch_numbers(pending: DataFrame, key: list[str], order: list[str], most_count: int, most_tokens: int) -> DataFrame:
    """pending with batch: greedy by count and tokens within each key, in order.

    A key's rows are folded in one row, so keys must have a bounded number of rows: a range of documents, not a language.
    """
    row = F.struct(*order, F.struct(*pending.columns).alias("r"))
    grouped = pending.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    bins = folds.greedy_bins(F.transform("rows", lambda x: x["r"]["tokenCount"]), most_tokens, 0, most_count)
    return grouped.withColumn("bins", bins).select(F.explode(F.arrays_zip("rows", "bins")).alias("z")).select("z.rows.r.*", F.col("z.bins").alias("batch"))


def with_retry(call: Callable, attempts: int, base_ms: float, most_ms: float, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random):
    """Calls again after transient errors, ``attempts`` times in all. The pause doubles up to ``most_ms`` and is shortened at random by up
    to half; a pause that the provider names is kept, up to ``most_ms``."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except TransientProviderError as error:
            if attempt == attempts:
                raise
            own = min(base_ms * 2 ** (attempt - 1), most_ms) * (0.5 + draw() / 2)
            sleep((own if error.retry_after_ms is None else min(error.retry_after_ms, most_ms)) / 1000)


class Cancelled(TransientProviderError):
    """The call was told to stop."""


class CancelToken:
    """Tells a running call that nobody waits for it any more. A provider that takes ``cancel`` should look at it, or wait on it,
    between its steps, and hand it to what it calls."""

    def __init__(self) -> None:
        self._stop, self._closers = threading.Event(), []

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def check(self) -> None:
        """Raises where the call was told to stop."""
        if self.cancelled:
            raise Cancelled("the call was cancelled")

    def wait(self, seconds: float) -> None:
        """Sleeps, but raises at once where the call is told to stop."""
        if self._stop.wait(seconds):
            self.check()

    def on_cancel(self, close: Callable[[], None]) -> None:
        """Something to close, such as a connection that a read blocks on, when the call is told to stop."""
        self._closers.append(close)
        if self.cancelled:
            close()

    def cancel(self) -> None:
        self._stop.set()
        for close in self._closers:
            close()


def within(seconds: float, call: Callable, grace_s: float = 5.0):
    """The call's result; a transient error if it takes longer. A call with a parameter gets a token, which is then cancelled.

    The call is waited for up to ``grace_s`` after that, so that a provider which heeds its token leaves no thread behind.
    """
    token, pool = CancelToken(), concurrent.futures.ThreadPoolExecutor(1)
    try:
        running = pool.submit(call, token) if inspect.signature(call).parameters else pool.submit(call)
        try:
            return running.result(seconds)
        except concurrent.futures.TimeoutError:
            if not running.done():
                token.cancel()
                concurrent.futures.wait([running], grace_s)
                raise TransientProviderError(f"the request timed out after {seconds} s") from None
            raise  # the call's own
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def takes_token(provider: Callable) -> bool:
    """Does a provider have a parameter ``cancel``?"""
    try:
        return "cancel" in inspect.signature(provider).parameters
    except (TypeError, ValueError):
        return False


def in_order(answer: list) -> list:
    """Vectors in the order of their index where the answer is made of (index, vector) pairs; indexes must be 0, 1, ... once each."""
    if not answer or not all(isinstance(x, tuple) and len(x) == 2 for x in answer):
        return answer
    by_index = dict(answer)
    if sorted(by_index) != list(range(len(answer))):
        raise ValueError("the provider's indexes are not 0, 1, ... once each")
    return [by_index[i] for i in range(len(answer))]


def embed_with(pending: DataFrame, provider: Callable[[list[str]], list[list[float]]], dimensions: int, batch_size: int = 100, batch_tokens: int = 64_000, attempts: int = 5, base_ms: float = 500, most_ms: float = 30_000, timeout_s: float = 60) -> DataFrame:
    """pending with vector and error from a provider function that embeds a list of texts.

    The provider gives vectors in order, or (index, vector) pairs in any order. A call that takes longer than ``timeout_s`` counts as
    a transient error; a provider with a parameter ``cancel`` is told through it to stop. Batches are greedy within a task's rows. A batch that still fails after its retries fails all its rows; the
    run goes on.
    """
    pending = pending.drop("vector", "error")
    schema = T.StructType([*pending.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def call(texts: list[str]) -> Callable:
        return (lambda token: provider(texts, cancel=token)) if takes_token(provider) else (lambda: provider(texts))

    def embedded(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.copy()
        try:
            found = in_order(with_retry(lambda: within(timeout_s, call(rows["input"].tolist())), attempts, base_ms, most_ms))
            if len(found) != len(rows) or any(len(v) != dimensions or not all(map(_finite, v)) for v in found):
                raise ValueError("the provider's answer has the wrong count, size or values")
            out["vector"], out["error"] = [list(map(float, v)) for v in found], None
        except Exception as error:  # noqa: BLE001 - whatever a provider raises fails this batch only
            out["vector"], out["error"] = [None] * len(rows), str(error)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            start = size = 0
            tokens = frame["tokenCount"].tolist()
            for i, n in enumerate(tokens):
                if i > start and (i - start >= batch_size or size + n > batch_tokens):
                    yield embedded(frame.iloc[start:i])
                    start, size = i, 0
                size += n
            if len(frame):
                yield embedded(frame.iloc[start:])

    return pending.mapInPandas(run, schema)


def _finite(x: float) -> bool:
    return x is not None and x == x and abs(x) != float("inf")


def fake_embedded(pending: DataFrame, dimensions: int) -> DataFrame:
    """pending with the deterministic offline vector, as a plain expression."""
    return pending.withColumns({"vector": vectors.fake_embedding(F.col("input"), dimensions), "error": F.lit(None).cast("string")})


def unembedded(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates whose embeddingId is not among the existing ones."""
    return candidates.join(existing.select("embeddingId"), "embeddingId", "left_anti")


def failure_counts(statuses: DataFrame, failed: Column, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """failed, n and aborts (the share of failures is over the threshold), in all or by columns."""
    n, bad = F.count("*"), F.count_if(failed)
    return statuses.groupBy(*by).agg(bad.alias("failed"), n.alias("n"), (bad > threshold * n).alias("aborts"))


def check_failures(statuses: DataFrame, failed: Column, threshold: float = 0.5) -> tuple[int, int]:
    """(failed, all) rows; raises where the share of failures is over the threshold."""
    row = failure_counts(statuses, failed, threshold).first()
    if row["aborts"]:
        raise FailureRatioExceeded(f"{row['failed']} of {row['n']} rows failed")
    return row["failed"], row["n"]


def fixed_batches(df: DataFrame, size: int, key: str, order: str) -> DataFrame:
    """df with batch: ``size`` rows each within the key, in order."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))
