"""ZIP archives to documents: the guarded scan, entries that replace others, front matter and structure."""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import ids, text
from ragloom.operators import markdown
from ragloom.sources import zipsource
from ragloom.sources.zipsource import ArchiveError, check_entry_name, is_safe_name  # noqa: F401 - the archive's rules

def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    zipsource.register(spark)
    return spark.read.format("zipdocs").options(path=path, **options).load()


def list_archives(spark: SparkSession, path: str, max_entries: int = 10_000, max_bytes: int = 524_288_000) -> DataFrame:
    """Every entry of the archives below ``path``, directories too, from the central directories alone; content is null."""
    return _load(spark, path, content="false", maxEntries=max_entries, maxBytes=max_bytes)


def write_archives(files: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> None:
    """Files (sourcePath, content) as ZIP archives of about so many bytes in a folder; each task writes its own.

    A task that is run again writes its files once more: ``latest_entries`` takes each path once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = zipsource.filesystem(folder)
        system.create_dir(inner, recursive=True)
        made, held, archive, out, begun = [], 0, None, None, ""

        def finish() -> None:
            archive.close()
            out.close()
            system.move(begun, made[-1])  # only a whole archive has an archive's name

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None or held > archive_bytes:
                    if archive is not None:
                        finish()
                    made.append(f"{inner}/{uuid.uuid4().hex}.zip")
                    begun, held = made[-1] + ".part", 0
                    out = system.open_output_stream(begun)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(name.as_py(), content.as_py())
                held += len(content.as_py())
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    files.select("sourcePath", "content").mapInArrow(run, "archive string").write.format("noop").mode("overwrite").save()


def archive_totals(spark: SparkSession, path: str, max_entries: int = 10_000, max_bytes: int = 524_288_000) -> DataFrame:
    """(archive, totalEntries) of the archives below ``path``: directories and entries that no glob matches count.

    Only central directories are read.
    """
    return list_archives(spark, path, max_entries, max_bytes).groupBy("archive").agg(F.count("*").alias("totalEntries"))


#: Failures that a summary names; all are counted.
FAILURES_NAMED = 1000


def ingestion_summary(totals: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: totalEntries of all archives, and of the documents read from them matched, succeeded, failed (error is set) and failures.

    failures names the first FAILURES_NAMED (sourcePath, error), by path; each task sends no more than these.
    """
    failed = documents.where("error is not null").select("sourcePath", "error").orderBy("sourcePath").limit(FAILURES_NAMED)
    named = failed.agg(F.sort_array(F.collect_list(F.struct("sourcePath", "error"))).alias("failures"))
    counted = documents.agg(F.count("*").alias("matched"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    all_entries = totals.agg(F.coalesce(F.sum("totalEntries"), F.lit(0)).alias("totalEntries"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731 - a row each
    return one(all_entries).join(one(counted), "one").join(one(named), "one").drop("one")


def scan_archives(spark: SparkSession, path: str, glob: str = "**/*.md", max_entries: int = 10_000, max_bytes: int = 524_288_000, partition_bytes: int = zipsource.PARTITION_BYTES) -> DataFrame:
    """One row a matching file of the archives below ``path``. All entries count against the limits, matching or not."""
    return _load(spark, path, glob=glob, maxEntries=max_entries, maxBytes=max_bytes, partitionBytes=partition_bytes).drop("directory")


def latest_entries(entries: DataFrame, path: str) -> DataFrame:
    """entries of the archives below ``path`` without those that a later one with the same sourcePath replaces.

    Later is: in an archive whose name comes later, or further on in the same archive. The replaced ones are found from the
    central directories alone; there are few, so contents are not shuffled for them.
    """
    listed = list_archives(entries.sparkSession, path, 2**31 - 1, 2**62).where("not directory").select("sourcePath", "archive", "position")
    last = Window.partitionBy("sourcePath").orderBy(F.desc("archive"), F.desc("position"))
    replaced = listed.withColumn("rn", F.row_number().over(last)).where("rn > 1").drop("rn")
    return entries.join(replaced, ["sourcePath", "archive", "position"], "left_anti")


def split_front_matter(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """documents with frontMatter (JSON, null without), body and error. Malformed front matter is that document's error alone."""
    keep = [c for c in documents.columns if c not in ("frontMatter", "body", "error")]
    schema = documents.select(*keep).schema.add("frontMatter", "string").add("body", "string").add("error", "string")
    at = keep.index(raw)

    def one(value: str | None) -> tuple[str | None, str | None, str | None]:
        found = re.match(r"\ufeff?---[ \t]*\r?\n(.*?)(?:^|\r?\n)---[ \t]*(?:\r?\n|\Z)", value or "", re.DOTALL)
        if not found:
            return None, value, None
        try:
            data = yaml.safe_load(found[1]) or {}
            if not isinstance(data, dict):
                raise yaml.YAMLError("front matter is no mapping")
            return json.dumps(data, default=str, ensure_ascii=False), value[found.end() :], None
        except yaml.YAMLError as error:
            return None, None, str(error).split("\n")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in markdown.small_batches(batches, at):
            out = [one(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[i] for r in out], pa.string()) for i in range(3)]], names=[*keep, "frontMatter", "body", "error"])

    return documents.select(*keep).mapInArrow(run, schema)


def structured_documents(entries: DataFrame, default_language: str = "en") -> DataFrame:
    """Entries as documents (bytes that are no UTF-8 become U+FFFD): documentId, title, language, wordCount, contentHash, headings, codeBlocks, body, error."""
    raw = entries.select("sourcePath", F.make_valid_utf8(F.col("content").cast("string")).alias("raw")) if dict(entries.dtypes)["content"] == "binary" else entries.select("sourcePath", F.col("content").alias("raw"))
    split = split_front_matter(raw).withColumn("documentId", ids.document_id(F.col("sourcePath"))).withColumn("body", text.clean(F.col("body")))
    outlined = markdown.outlines(split)
    field = lambda name: _text_field(F.col("frontMatter"), name)
    return outlined.select(
        "documentId", "sourcePath", text.resolve_title(field("title"), F.col("firstH1"), F.col("sourcePath")).alias("title"), text.resolve_language(field("lang"), field("language"), default_language).alias("language"),
        text.word_count(F.col("body")).alias("wordCount"), ids.content_hash(F.col("body")).alias("contentHash"), "headings", "codeBlocks", "frontMatter", "body", F.coalesce("error", "outlineError").alias("error"),
    )


def _text_field(json_text: Column, name: str) -> Column:
    """A field of front matter if it is text; a field of another kind is empty text, an absent one null."""
    value = F.try_variant_get(F.try_parse_json(json_text), f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.get_json_object(json_text, f"$.{name}")).when(value.isNotNull() & (kind != "VOID"), F.lit(""))
