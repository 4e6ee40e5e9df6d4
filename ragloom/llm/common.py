"""Helpers shared by the training-data operators: shared storage, appended columns, word hashing."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch that are worked on at a time, and about how many bytes of input (one longer row stands alone).
SLICE_ROWS, SLICE_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        path = "file://" + tempfile.mkdtemp(prefix="spark-ragloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back, so that several passes share one computation."""
    path = f"{shared_dir(df.sparkSession)}/ragloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of up to so many rows is broadcast by ``lookup``.
BROADCAST_ROWS = 50_000
#: A key is heavy if it has over one in so many of the rows that are looked up; so fewer keys than this are heavy.
HEAVY_SHARE = 1000


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, most: int | None = None) -> DataFrame:
    """left with the columns of right but ``weight`` (left join on one column; null keys match nothing).

    right is a written table that has each key once; ``weight`` tells how many rows of left have it. Up to ``most`` rows
    (BROADCAST_ROWS if None) of right are broadcast. A larger one is shuffled, but for the heavy keys, of which there are fewer than
    HEAVY_SHARE: these are broadcast, so that a hot key is never dealt to one task.
    """
    if right.limit((BROADCAST_ROWS if most is None else most) + 1).count() <= (BROADCAST_ROWS if most is None else most):
        return left.join(F.broadcast(right.drop(weight)), key, "left")
    total = right.agg(F.sum(weight)).first()[0] or 0
    names = [c for c in right.columns if c not in (key, weight)]
    heavy = right.where(F.col(weight) * HEAVY_SHARE > total)
    marked = left.join(F.broadcast(heavy), key, "left")
    done = F.col(weight).isNotNull() | F.col(key).isNull()
    rest = marked.where(~done).drop(weight, *names).join(right.where(F.col(weight) * HEAVY_SHARE <= total).drop(weight), key, "left")
    return marked.where(done).drop(weight).unionByName(rest)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for documents that models may learn from: those with a doc_id that are not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., list[list]]], keep: list[str] | None = None) -> DataFrame:
    """df with columns computed in Python from the input columns, one Arrow batch at a time.

    ``make()`` runs once a task and returns a function from lists (one for each input) to lists (one for each field).
    An existing column with the name of a new field is replaced; ``keep`` names the columns that stay (all if None).
    """
    taken = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    arrow_types = [_arrow_type(f.dataType) for f in fields]
    n_keep = len(keep)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at, end in row_slices(whole.columns[n_keep:]):
                batch = whole.slice(at, end - at)
                out = work(*[batch.column(n_keep + i).to_pylist() for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_keep], *[x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(out, arrow_types, strict=True)]], names=names
                )

    return source.mapInArrow(run, schema)


def row_slices(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded number and bytes."""
    n = len(columns[0]) if columns else 0
    sizes = np.ones(n, np.int64)
    for column in columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < n:
        before = total[at - 1] if at else 0
        end = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right"))), n)
        yield at, end
        at = end


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}[kind.typeName()]


#: Any odd 64-bit number serves; its powers and inverse powers give the polynomial hash of every word from one running sum.
_BASE = 0x9E3779B97F4A7C15
_SEPARATORS = np.frombuffer(bytes(0 if chr(i).isspace() or (i < 128 and not chr(i).isalnum()) else (i + 32 if 65 <= i <= 90 else i) for i in range(256)), dtype=np.uint8).copy()
_SEPARATORS[0x80:] = np.arange(0x80, 0x100, dtype=np.uint8)
_IN_WORDS, _VALUES = _SEPARATORS != 0, np.where(_SEPARATORS != 0, _SEPARATORS.astype(np.uint64) + np.uint64(1), np.uint64(0))


class WordHasher:
    """Splits UTF-8 texts into words (ASCII letters lower-cased, ASCII punctuation and white space as separators) and hashes all of them at once."""

    CHUNK = 1 << 20

    def __init__(self) -> None:
        self._grow(self.CHUNK)

    def _grow(self, n: int) -> None:
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))
            self.inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]))

    def words(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hash of each word, index of its text), in order."""
        joined = b" ".join(t or b"" for t in texts)
        lengths = np.array([len(t or b"") for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        raw = np.frombuffer(joined, dtype=np.uint8)
        # Words begin and end where separators do; one stands before and one after all.
        inside = np.zeros(len(raw) + 2, bool)
        np.take(_IN_WORDS, raw, out=inside[1:-1], mode="clip")
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        if len(raw) >= len(self.power):
            self._grow(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            values = _VALUES[raw]
            values *= self.power[: len(raw)]
            np.cumsum(values, out=total[1:])
            h = (total[end] - total[begin]) * self.inverse[begin] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, np.concatenate([starts, [len(raw) + 1]]))))


def slices(texts: list[bytes | None], most: int = WordHasher.CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of the list with about ``most`` bytes each (one longer text is a range of its own)."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def crc(text: str) -> int:
    """CRC-32 of the text's UTF-8 bytes."""
    return zlib.crc32(text.encode())
