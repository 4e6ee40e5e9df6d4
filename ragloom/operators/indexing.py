"""Embedding records to points: provenance checks, joins with chunks and parents, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import ids, text
from ragloom.functions.vectors import norm


def rejection(provider: str, model: str, version: str, dimensions: int, allow_fake: bool = False) -> Column:
    """Why a record must not be indexed, or null. The first rule that is broken counts."""
    bad_value = F.exists("vector", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    same = (F.col("provider") == provider) & (F.col("model") == model) & (F.col("modelVersion") == version) & (F.col("dimensions") == dimensions)
    fake = F.lit(not allow_fake) & (F.col("provider") == "fake")
    return F.when(fake, "fakeProvider").when(~F.coalesce(same, F.lit(False)), "provenance").when(F.coalesce(F.size("vector"), F.lit(0)) <= 0, "empty").when(F.size("vector") != dimensions, "dimensions").when(bad_value, "values")


def index_status(records: DataFrame, chunks: DataFrame, reason: Column) -> DataFrame:
    """records with their chunk's columns, parentText and status: skippedFakeProvider, skippedByProvenanceMismatch or indexed.

    A record without a chunk counts as a mismatch; a missing parent leaves parentText null. Repeated chunk ids count once. Records
    without a parent are dealt by their own chunk's id, not all together, and match nothing.
    """
    own = chunks.dropDuplicates(["chunkId"])
    titles = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("documentTitle", "sourcePath")]
    records = records.drop("documentTitle", "sourcePath")  # the chunk's are kept
    joined = records.withColumn("reason", reason).join(own.select("chunkId", "parentChunkId", "chunkType", "headingPath", "text", *titles, F.lit(True).alias("found")), "chunkId", "left")
    parents = own.select(F.col("chunkId").alias("parent"), F.lit(False).alias("alone"), F.col("text").alias("parentText"))
    joined = joined.withColumns({"parent": F.coalesce("parentChunkId", "chunkId"), "alone": F.col("parentChunkId").isNull()}).join(parents, ["parent", "alone"], "left").drop("parent", "alone")
    status = F.when(F.col("reason") == "fakeProvider", "skippedFakeProvider").when(F.col("reason").isNotNull() | F.col("found").isNull(), "skippedByProvenanceMismatch").otherwise("indexed")
    return joined.withColumn("status", status).drop("found")


def counts(status: Column, batch_size: int = 200) -> list[Column]:
    """Counts of an indexing run's statuses."""
    done = F.count_if(status == "indexed")
    return [F.count(F.lit(1)).alias("scanned"), *[F.count_if(status == k).alias(k) for k in ("skippedFakeProvider", "skippedByProvenanceMismatch")], done.alias("attempted"), F.ceil(done / batch_size).alias("batches")]


def accounting(statuses: DataFrame, batch_size: int = 200) -> DataFrame:
    """One row of counts."""
    return statuses.agg(*counts(F.col("status"), batch_size))


def no_points(spark: SparkSession) -> DataFrame:
    """No rows, with the columns of a collection's points."""
    return spark.createDataFrame([], "id string, vector array<double>, norm double, chunkId string, documentId string, parentChunkId string, chunkType string, contentHash string, headingPath string, text string, parentText string, domain string, embeddingId string, documentTitle string, sourcePath string, provider string, model string, modelVersion string, dimensions int")


def points(indexed: DataFrame, domain: str) -> DataFrame:
    """Rows of a collection: id, vector, norm and the payload's columns. The parent's text is kept with the point.

    Columns that the input lacks (documentTitle, sourcePath, the model's provenance) are null.
    """
    kinds = {"documentTitle": "string", "sourcePath": "string", "provider": "string", "model": "string", "modelVersion": "string", "dimensions": "int"}
    more = [F.col(c).cast(k).alias(c) if c in indexed.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    return indexed.select(ids.point_id(F.col("embeddingId")).alias("id"), "vector", norm(F.col("vector")).alias("norm"), "chunkId", "documentId", "parentChunkId", "chunkType", "contentHash", text.breadcrumb(F.col("headingPath")).alias("headingPath"), "text", "parentText", F.lit(domain).alias("domain"), "embeddingId", *more)
