"""Incremental embedding: a file stream of chunks that embeds what its state has not seen, and upserts the points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ragloom.operators import embedding
from ragloom.sources.store import Collections


def chunk_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Keeps the ids of a stream on disk, not on the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def embed_batch(chunks: DataFrame, existing: DataFrame, provider: str, model: str, version: str, dimensions: int) -> DataFrame:
    """New records of a table of chunks: ids that exist already, and repeats, are left out."""
    inputs = embedding.embedding_inputs(chunks).where("input is not null")
    new = embedding.with_embedding_ids(inputs, provider, model, version, dimensions).dropDuplicates(["embeddingId"])
    return embedding.fake_embedded(embedding.unembedded(new, existing), dimensions)


def new_inputs(stream: DataFrame, provider: str, model: str, version: str, dimensions: int, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Inputs of a stream of chunks whose embeddingId has not been seen before, by the stream's own state.

    Without a watermark every id is kept for good. With one, (timestamp column, delay), an id is kept for the delay: repeats that come
    later are embedded again, which changes nothing in a collection.
    """
    inputs = embedding.with_embedding_ids(embedding.embedding_inputs(stream).where("input is not null"), provider, model, version, dimensions)
    return inputs.dropDuplicates(["embeddingId"]) if watermark is None else inputs.withWatermark(*watermark).dropDuplicatesWithinWatermark(["embeddingId"])


def start(stream: DataFrame, store: Collections, name: str, checkpoint: str, to_points: Callable[[DataFrame], DataFrame], dimensions: int, provider: str = "fake", model: str = "fake-model", version: str = "1", watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Embeds a stream's chunks and upserts the points, until the files at hand are done.

    What has been embedded is known from the stream's state, kept with its checkpoint in RocksDB: no micro-batch reads the collection.
    A micro-batch that is repeated after a failure, or a stream that begins anew, puts the same points over themselves.
    """
    store.ensure(name, dimensions)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def one(batch: DataFrame, batch_id: int) -> None:
        store.upsert(name, to_points(embedding.fake_embedded(batch, dimensions)).withColumn("seq", F.lit(batch_id)))

    fresh = new_inputs(stream, provider, model, version, dimensions, watermark)
    return fresh.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
