"""The whole way from archives to answers, with every step's settings taken from ``Settings``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ragloom.config import ConfigError, Settings
from ragloom.functions import ids, vectors
from ragloom.operators import answering, embedding, indexing, narrow, retrieval
from ragloom.sources import records, zipdocs
from ragloom.sources.store import Collections

#: Gives a list of texts' vectors, or (index, vector) pairs.
Provider = Callable[[list[str]], list]


class Engine:
    """Steps that hand DataFrames on. ``provider`` embeds texts and ``model`` answers prompts; without them the deterministic offline
    vectors and the offline answer are used. ``store`` is anything with the methods of ``Collections`` that are called here: ensure,
    read and upsert."""

    def __init__(self, spark: SparkSession, store: Collections, settings: Settings | None = None, provider: Provider | None = None, model: Callable | None = None) -> None:
        self.spark, self.store, self.settings, self.provider, self.answerer = spark, store, settings or Settings(), provider, model
        if provider is None and self.settings.embedding_provider != "fake":
            raise ConfigError(f"no function for the provider {self.settings.embedding_provider}")

    @property
    def model(self) -> tuple[str, str, str, int]:
        s = self.settings
        return s.embedding_provider, s.embedding_model, s.embedding_model_version, s.embedding_dimensions

    @property
    def collection(self) -> str:
        provider, model, version, dimensions = self.model
        return ids.collection_name(self.settings.domain, provider, model, dimensions, version)

    def documents(self, path: str) -> DataFrame:
        """Structured documents of the archives below a path, one for each path within them: of equal paths the last counts."""
        s = self.settings
        entries = zipdocs.scan_archives(self.spark, path, s.include_glob, s.max_entry_count, s.max_uncompressed_bytes)
        return zipdocs.structured_documents(zipdocs.latest_entries(entries, path), s.default_language)

    def summary(self, path: str, documents: DataFrame) -> DataFrame:
        """totalEntries, matched, succeeded, failed of a run, and failures (sourcePath, error)."""
        return zipdocs.ingestion_summary(zipdocs.archive_totals(self.spark, path, self.settings.max_entry_count, self.settings.max_uncompressed_bytes), documents)

    def chunks(self, documents: DataFrame) -> DataFrame:
        """Chunks of the readable documents, with their title and path. A document that fails gives one row with its error alone."""
        s = self.settings
        readable = documents.where("error is null").withColumnRenamed("title", "documentTitle")
        return narrow.document_chunks(readable, s.max_chunk_size, s.min_chunk_size, s.length_strategy, s.overlap_strategy, s.overlap_sentences, s.include_parent_chunks, keep=("documentTitle", "sourcePath"))

    def embed(self, chunks: DataFrame, path: str) -> DataFrame:
        """Embeds what the records below ``path`` lack and appends it; one row of counts. Raises where too many rows fail.

        The inputs are computed once: counts are gathered while the records are written, and a provider is asked once. Of rows with
        one embeddingId one is embedded; the others count as alreadyEmbedded.
        """
        s = self.settings
        inputs = embedding.embedding_inputs(chunks.where("chunkId is not null"), s.input_max_tokens, s.include_heading_context)
        known = records.existing_ids(self.spark, path, *self.model)
        status = embedding.run_status(embedding.once(embedding.with_embedding_ids(inputs, *self.model), s.chunk_types.split(",")), known, s.chunk_types.split(","), s.run_cap)
        scanned, made = Observation(), Observation()
        status = status.observe(scanned, *embedding.counts(F.col("status")))
        pending, dimensions = status.where("status = 'pending'").drop("status"), s.embedding_dimensions
        if self.provider is None:
            done = embedding.fake_embedded(pending, dimensions)
        else:
            done = embedding.embed_with(pending, self.provider, dimensions, s.embedding_batch_size, s.embedding_batch_tokens, s.embedding_max_attempts, s.embedding_retry_base_ms, s.embedding_retry_max_ms, s.embedding_timeout_s)
        done = done.observe(made, F.count_if(F.col("vector").isNotNull()).alias("succeeded"), F.count_if(F.col("vector").isNull()).alias("failed"))
        records.append_records(records.embedding_records(done, *self.model), path)
        row = {**scanned.get, **made.get}
        if row["attempted"] and row["failed"] / row["attempted"] > s.failure_threshold:
            raise embedding.FailureRatioExceeded(f"{row['failed']} of {row['attempted']} rows failed")
        return self.spark.createDataFrame([row])

    def index(self, path: str, chunks: DataFrame) -> DataFrame:
        """Puts the stored records' points into the collection; one row of counts, gathered while they are written."""
        s = self.settings
        status = indexing.index_status(records.read_records(self.spark, path), chunks, indexing.rejection(*self.model, s.allow_fake_provider))
        self.store.ensure(self.collection, s.embedding_dimensions)
        counted = Observation()
        status = status.observe(counted, *indexing.counts(F.col("status"), s.index_batch_size))
        self.store.upsert(self.collection, indexing.points(status.where("status = 'indexed'"), s.domain).withColumn("seq", F.lit(0)))
        return self.spark.createDataFrame([{**counted.get, "succeeded": counted.get["attempted"]}])

    def search(self, questions: DataFrame, top_k: int | None = None, threshold: float | None = None, **payload) -> DataFrame:
        """Results of all questions (queryId, question), for ``ask``. Payload fields restrict what is searched."""
        s = self.settings
        k = retrieval.top_k_limit(top_k, s.default_top_k, s.max_top_k)
        stored = self.store.read(self.collection)
        points = (indexing.no_points(self.spark) if stored is None else stored).where(retrieval.payload_filter(**payload))
        fine = questions.where(retrieval.question_reason(F.col("question")).isNull())
        if self.provider is None:
            asked = fine.select("queryId", vectors.fake_embedding(F.col("question"), s.embedding_dimensions).alias("queryVector"))
        else:
            given = fine.select("queryId", F.col("question").alias("input"), F.lit(0).alias("tokenCount"))
            asked = embedding.embed_with(given, self.provider, s.embedding_dimensions, s.embedding_batch_size, attempts=s.embedding_max_attempts, base_ms=s.embedding_retry_base_ms, most_ms=s.embedding_retry_max_ms, timeout_s=s.embedding_timeout_s)
            asked = asked.where("vector is not null").select("queryId", F.col("vector").alias("queryVector"))
        best = retrieval.batch_top_k(points.select("id", "vector"), asked, k, s.score_threshold if threshold is None else threshold)
        return retrieval.results(best.join(points.drop("vector", "norm"), "id"), s.expand_parents).withColumn("position", F.col("rank")).drop("rank")

    def ask(self, questions: DataFrame, **search) -> DataFrame:
        """One row a question: answer, reason, cited, tokens and cost."""
        s = self.settings
        return answering.ask(questions, self.search(questions, **search), s.max_context_chunks, s.max_context_chars, s.min_retrieval_score, s.max_prompt_tokens, s.input_price_per_million, s.output_price_per_million, self.answerer)
