"""Embedding records as JSON lines and chunks as JSON: scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "embeddingId string, chunkId string, documentId string, sourcePath string, vector array<double>, dimensions int, provider string, model string, modelVersion string, contentHash string, inputHash string, inputTokenCount int, truncated boolean, createdAt timestamp"


class RecordError(ValueError):
    """Stored records are corrupt or belong to another model."""


def append_records(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines. ``existing_ids`` adds their identities to the index beside them when it is next asked."""
    records.write.mode("append").json(path)


def embedding_records(embedded: DataFrame, provider: str, model: str, version: str, dimensions: int) -> DataFrame:
    """Rows with a vector as records to append (the columns of RECORD); failed rows are left out. A missing sourcePath is null."""
    path = F.col("sourcePath") if "sourcePath" in embedded.columns else F.lit(None).cast("string")
    return embedded.where("vector is not null").select(
        "embeddingId", "chunkId", "documentId", path.alias("sourcePath"), F.col("vector").cast("array<double>").alias("vector"), F.lit(dimensions).alias("dimensions"), F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        F.lit(version).alias("modelVersion"), "contentHash", "inputHash", F.col("tokenCount").cast("int").alias("inputTokenCount"), "truncated", F.current_timestamp().alias("createdAt"),
    )


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Structured documents as JSON lines, which ``read_json_documents`` reads back."""
    documents.write.mode(mode).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records; any line that is no record fails the scan. Blank lines do not count."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


#: What resumption needs of a record.
_IDENTITY = "embeddingId string, provider string, model string, modelVersion string, dimensions int"


def existing_ids(spark: SparkSession, path: str, provider: str, model: str, version: str, dimensions: int) -> DataFrame:
    """Distinct embeddingId of the records so far; none where the path does not exist. Records of another model raise.

    The ids come from an index beside the records: Parquet with the identities alone, each with its file and that file's size, so
    that no vector is read again. Files that the index lacks, or has at another size, are read once and added.
    """
    index, files = _index_of(spark, path)
    if not files:
        return spark.createDataFrame([], "embeddingId string")
    stored = spark.read.schema(_IDENTITY + ", file string, size long").parquet(index) if _exists(spark, index) else None
    indexed = {(r["file"], r["size"]) for r in stored.select("file", "size").distinct().collect()} if stored is not None else set()  # a row a file
    missing = sorted(set(files) - indexed)
    if missing:
        _identities(spark, path, [f for f, _ in missing]).join(F.broadcast(spark.createDataFrame(missing, "file string, size long")), "file").write.mode("append").option("parquet.bloom.filter.enabled#embeddingId", "true").parquet(index)
        stored = spark.read.schema(_IDENTITY + ", file string, size long").parquet(index)
    good = stored.where("embeddingId is not null")
    same = (F.col("provider") == provider) & (F.col("model") == model) & (F.col("modelVersion") == version) & (F.col("dimensions") == dimensions)
    if not good.where(~F.coalesce(same, F.lit(False))).isEmpty():
        raise RecordError(f"{path}: records of another model, version or size")
    return good.select("embeddingId").distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - the public way to ask any file system
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def _index_of(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int]]]:
    """(folder of the id index, the record files with their sizes). Scans of the records pass over the folder, as its name begins with _."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not files.exists(p):
        return "", []
    listed = [s for s in files.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", ".")) and s.getLen()]
    index = f"{path.rstrip('/')}/_ids" if files.getFileStatus(p).isDirectory() else f"{p.getParent()}/_{p.getName()}-ids"
    return index, [(s.getPath().toString(), s.getLen()) for s in listed]


def _identities(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """(identity, file) of the records in some files; a file without any has one row with nulls, so that it counts as read.

    A last line that a broken-off append has left incomplete is passed over; other corrupt lines raise. Reads of a file keep its
    lines in order within each split, so the last line of a file is the one without successor.
    """
    lines = spark.read.text(files).where("trim(value) != ''").withColumns({"file": F.col("_metadata.file_path"), "at": F.monotonically_increasing_id()})
    parsed = lines.withColumn("r", F.from_json("value", _IDENTITY + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    fine = F.col("r._corrupt_record").isNull() & F.col("r.embeddingId").isNotNull()
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    if not parsed.where(~fine).select("file", "at").join(last, "file").where("at < last").isEmpty():
        raise RecordError(f"{path}: a line before the last is no record")
    named = spark.createDataFrame([(f,) for f in files], "file string").join(last.select("file"), "file", "left_anti")
    none = named.select(*[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in _IDENTITY.split(", ")], "file")
    found = parsed.select(*[F.when(fine, F.col(f"r.{k.split()[0]}")).alias(k.split()[0]) for k in _IDENTITY.split(", ")], "file")
    return found.unionByName(none)


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    chunks.write.mode(mode).parquet(path)


def read_json_documents(spark: SparkSession, path: str, schema: str, glob: str = "*.json", whole_files: bool = True) -> DataFrame:
    """Documents or chunk arrays, one JSON value (object or array of objects) a file; JSON lines without ``whole_files``."""
    return spark.read.schema(schema).option("multiLine", whole_files).option("pathGlobFilter", glob).json(path)
