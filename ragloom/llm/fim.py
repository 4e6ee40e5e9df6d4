"""Fill-in-middle: an index of distinct texts with Elias-Fano lists of unit boundaries, joined back to the documents for each seeded cut.

Documents with the same digest are one entry of the index, once their texts have been compared in full. An entry holds the text
and the byte offsets of its units' boundaries, made once however many documents share the text. A document then needs two
selections in the list, and the rest is cutting bytes. Texts that hold many of the rows are indexed first and their
documents dealt out by a salt; the other texts are shuffled once, merged with their documents in order of the digest, and their
lists made as they come.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import HEAVY_SHARE, written

#: Markers before prefix, suffix and middle (fixed values). A text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Every so many boundaries the place of its bit is kept, so that a selection looks at few bytes.
SAMPLE_EVERY = 256
_BLOCK = 1 << 20
_HEAD = struct.Struct("<QQB")


def code_points(raw: bytes) -> Iterator[np.ndarray]:
    """Byte offsets at which code points of UTF-8 begin, by blocks."""
    for at in range(0, len(raw), _BLOCK):
        part = np.frombuffer(raw, np.uint8, min(_BLOCK, len(raw) - at), at)
        yield np.flatnonzero((part & 0xC0) != 0x80) + at


def pattern_units(raw: bytes, pattern: re.Pattern) -> Iterator[np.ndarray]:
    """Byte offsets at which the pattern's matches begin, left to right over code points; what lies before the first belongs to it."""
    text, found, byte, char = raw.decode(), [], 0, 0
    for match in pattern.finditer(text):
        if match.end() > match.start():
            byte, char = byte + len(text[char : match.start()].encode()), match.start()
            found.append(byte if found else 0)
            if len(found) >= _BLOCK:
                yield np.array(found[:-1], np.int64)
                found = found[-1:]
    yield np.array(found, np.int64)


def encode(raw: bytes, pattern: re.Pattern | None = None) -> bytes:
    """Elias-Fano list of the boundaries of a text's units: 0, the starts of the others, and the length in bytes.

    Of each boundary the low bits are stored as they are, the high bits as a one at (high + number) in a bit string. Without a
    pattern a unit is a code point. Works block by block, so memory beyond the text is a fraction of it.
    """
    starts = (lambda: code_points(raw)) if pattern is None else (lambda: pattern_units(raw, pattern))
    count = sum(map(len, starts())) + 1
    low_bits = max(0, (len(raw) // count).bit_length() - 1)
    high = np.zeros(((len(raw) >> low_bits) + count + 7) // 8, np.uint8)
    low, samples, number = np.zeros((count * low_bits + 7) // 8, np.uint8), [], 0

    def put(values: np.ndarray) -> None:
        nonlocal number
        places = (values >> low_bits) + np.arange(number, number + len(values))
        samples.append(places[-number % SAMPLE_EVERY :: SAMPLE_EVERY])
        _set_bits(high, places)
        if low_bits:
            bits = np.flatnonzero(((values[:, None] >> np.arange(low_bits)) & 1).ravel()) + number * low_bits
            _set_bits(low, bits)
        number += len(values)

    for block in starts():
        if len(block):
            put(block)
    put(np.array([len(raw)], np.int64))
    return _HEAD.pack(count, len(raw), low_bits) + np.concatenate(samples).astype("<u8").tobytes() + low.tobytes() + high.tobytes()


def _set_bits(into: np.ndarray, places: np.ndarray) -> None:
    if len(places):
        first = int(places[0]) >> 3
        flags = np.zeros(int(places[-1]) - 8 * first + 1, bool)
        flags[places - 8 * first] = True
        packed = np.packbits(flags, bitorder="little")
        into[first : first + len(packed)] |= packed


def units_of(blob: bytes) -> int:
    """Number of units of an encoded text."""
    return _HEAD.unpack_from(blob)[0] - 1


def select(blob: bytes, number: int) -> int:
    """The boundary with this number (from 0) of an encoded list."""
    count, universe, low_bits = _HEAD.unpack_from(blob)
    samples = np.frombuffer(blob, "<u8", -(-count // SAMPLE_EVERY), _HEAD.size)
    at_low = _HEAD.size + samples.nbytes
    n_low = (count * low_bits + 7) // 8
    high = np.frombuffer(blob, np.uint8, offset=at_low + n_low)
    place, left = int(samples[number // SAMPLE_EVERY]), number % SAMPLE_EVERY
    if left:
        first = place >> 3
        last = (int(samples[number // SAMPLE_EVERY + 1]) >> 3) + 1 if number // SAMPLE_EVERY + 1 < len(samples) else len(high)
        part = high[first:last].copy()
        part[0] &= (0xFE << (place & 7)) & 0xFF  # what lies before the sampled bit, and it, do not count
        ones = np.cumsum(np.bitwise_count(part), dtype=np.int64)
        byte = int(np.searchsorted(ones, left))
        rest = left - (int(ones[byte - 1]) if byte else 0)
        place = 8 * (first + byte) + int(np.flatnonzero(np.unpackbits(part[byte : byte + 1], bitorder="little"))[rest - 1])
    value = (place - number) << low_bits
    if low_bits:
        bit = number * low_bits
        low = int.from_bytes(blob[at_low + (bit >> 3) : at_low + ((bit + low_bits + 7) >> 3)], "little")
        value |= (low >> (bit & 7)) & ((1 << low_bits) - 1)
    return value


def text_index(keyed: DataFrame) -> DataFrame:
    """(key, text): each distinct text of (key, text) once. All texts of a key are compared: the smallest must equal the largest.

    Two texts with one SHA-256 end the job.
    """
    grouped = keyed.groupBy("key").agg(F.min("text").alias("text"), F.max("text").alias("other"))
    same = F.when(F.col("text") == F.col("other"), F.col("text")).otherwise(F.raise_error(F.lit("two texts share a digest")))
    return grouped.select("key", same.alias("text"))


def with_bounds(index: DataFrame, pattern: str | None = None) -> DataFrame:
    """The index with the list of each text's boundaries."""
    compiled = re.compile(pattern) if pattern else None

    @F.pandas_udf(T.BinaryType())
    def boundaries(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(t.encode(), compiled) for t in texts], dtype=object)

    return index.withColumn("bounds", boundaries("text"))


_CUT = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second", "a", "b")])


def _selected(pattern: str | None) -> Callable[..., Column]:
    """(key, text, bounds, h1, h2) to the units, the numbers of both cuts and their byte offsets. A null list is made here, once for the
    rows of a key that follow one another."""
    compiled = re.compile(pattern) if pattern else None

    @F.pandas_udf(_CUT)
    def cuts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known, blob = None, b""
        for batch in batches:
            rows = []
            for key, text, bounds, h1, h2 in zip(*batch, strict=True):
                if key != known:
                    known, blob = key, encode(text.encode(), compiled) if bounds is None else bounds
                n = units_of(blob)
                if h1 is None or h1 != h1:
                    rows.append((n, None, None, None, None))
                else:
                    first, second = sorted((int(h1) % (n + 1), int(h2) % (n + 1)))
                    rows.append((n, first, second, select(blob, first), select(blob, second)))
            yield pd.DataFrame(rows, columns=_CUT.names, dtype="Int64")

    return cuts


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(documents: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, pattern: str | None = None) -> DataFrame:
    """One row a document: doc_id, text, n (units), form (plain, psm or spm), prefix_units, middle_units (null if plain), output.

    The cut, the share that stays plain and the order follow from the seed and doc_id only. A null text counts as empty. Empty
    texts, texts that hold a marker and documents without doc_id stay plain. Repeated rows are each a document. Other columns are
    left out. ``pattern`` names other units than code points: its matches, left to right.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    ids = written(docs.select("doc_id", "key"), "fim-documents")
    total = ids.count()
    counts = ids.groupBy("key").agg(F.count("*").alias("copies"))
    heavy = written(counts.where(F.col("copies") * HEAVY_SHARE > F.greatest(F.lit(total), F.lit(HEAVY_SHARE * HEAVY_SHARE))).withColumn("salts", F.ceil(F.col("copies") * HEAVY_SHARE / total).cast("int")), "fim-heavy")
    # A key is heavy with over a thousandth of the rows (and over a thousand): there are fewer than a thousand, of fixed size.
    known = F.broadcast(heavy.select("key", "salts"))
    texts = docs.select("key", "text")
    light_index = text_index(texts.join(known, "key", "left_anti").repartition("key"))
    light = ids.join(known, "key", "left_anti").join(light_index.hint("merge"), "key")
    joined = light.sortWithinPartitions("key").withColumn("bounds", F.lit(None).cast("binary"))  # the merge leaves them in this order
    if not heavy.isEmpty():
        heavy_index = written(with_bounds(text_index(texts.join(known, "key", "left_semi")), pattern), "fim-heavy-texts")
        salted = heavy_index.join(known, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        dealt = ids.join(known, "key").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("salts")).cast("int")).drop("salts")
        joined = joined.unionByName(dealt.join(salted, ["key", "salt"]).drop("salt"))
    return _cut(joined, seed, plain_percent, spm_percent, pattern)


def _cut(joined: DataFrame, seed: int, plain_percent: int, spm_percent: int, pattern: str | None) -> DataFrame:
    h = _draws(F.col("doc_id"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = F.col("doc_id").isNull() | (F.col("text") == "") | marked | (h[2] % 100 >= 100 - plain_percent)
    drawn = joined.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    drawn = drawn.withColumn("cut", _selected(pattern)("key", F.when(F.col("bounds").isNull(), F.col("text")), "bounds", F.when(cut, h[0]), F.when(cut, h[1])))
    raw, a, b = F.col("text").cast("binary"), F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    prefix, middle, suffix = (F.substring(raw, at + 1, size).cast("string") for at, size in ((F.lit(0), a), (a, b - a), (b, F.octet_length("text") - b)))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    return drawn.select("doc_id", "text", "cut.n", "form", F.col("cut.first").alias("prefix_units"), (F.col("cut.second") - F.col("cut.first")).alias("middle_units"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. A cut text holds no marker of its own, so each marker stands once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def transformed(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it."""
    made = fill_in_middle(documents)
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = """
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h from documents),
u as (select doc_id, text, length(text) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when doc_id is null or text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, substr(text, 1, a) as pre, substr(text, a + 1, b - a) as mid, substr(text, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(case form when 'psm' then concat('<P>', pre, '<S>', suf, '<M>', mid) when 'spm' then concat('<S>', suf, '<P>', pre, '<M>', mid) else text end) as output_sha256, sha256(text) as restored_sha256
from p"""
