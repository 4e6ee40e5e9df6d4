"""Periodic runs of words: Lyndon words found by a stack scanned right to left under both orders, extended to maximal runs.

A run of words with least period q has, under one of the two orders of the words, a Lyndon word of q words as its root; wherever
the root stands whole in the run, it is the longest Lyndon word that begins there. The stack gives these longest words in
one scan for both orders. Suffixes are compared, and roots extended, by the length of their longest common extension: a
binary search over rolling hashes whose result is checked word by word. Documents are worked on one by one, in place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are what ASCII white space parts (fixed pattern).
WORD = r"[^\x20\x09-\x0D]+"
#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS, LEAST_POWER = 6, 4
#: Prime modulus and base of the rolling hash; any large prime and base serve, as every result is checked.
_PRIME, _BASE = (1 << 61) - 1, 0x1D3A5F7C9B2E4681
_END = 1 << 62
_PART, _SPACE = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")


class CommonExtensions:
    """Lengths of common extensions within one sequence of word numbers.

    Up to eight words are compared as they are. Beyond, prefix hashes (made when first needed) are searched by doubling and
    halving, and the words found equal are compared; of each distance the last stretch found equal is kept and not compared again.
    """

    def __init__(self, words: list[int]) -> None:
        self.words, self.n, self.hashes, self.powers, self.known = words, len(words), None, None, {}

    def _prepare(self) -> None:
        h, power, self.hashes, self.powers = 0, 1, [0], [1]
        for w in self.words:
            h = (h * _BASE + w + 1) % _PRIME
            power = power * _BASE % _PRIME
            self.hashes.append(h)
            self.powers.append(power)

    def _same(self, i: int, j: int, size: int) -> bool:
        h, power = self.hashes, self.powers[size]
        return (h[i + size] - h[i] * power - h[j + size] + h[j] * power) % _PRIME == 0

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on (i < j)."""
        words, n, size = self.words, self.n, 0
        begin, stop = self.known.get(j - i, (n, n))  # found equal before; a difference or the end follows
        if begin <= i <= stop:
            return stop - i
        near = min(j + 8, n)
        while j + size < near and words[i + size] == words[j + size]:
            size += 1
        if i < begin <= i + size:
            self.known[j - i] = i, stop
            return stop - i
        if j + size < near or j + size == n:
            return size
        size = self._searched(i, j, size, begin, stop)
        self.known[j - i] = i, i + size
        return size

    def _searched(self, i: int, j: int, size: int, begin: int, stop: int) -> int:
        """``right`` from a known size on: the hashes give it by doubling and halving, then the words are compared."""
        if self.hashes is None:
            self._prepare()
        words, low, most = self.words, size, self.n - j
        step = size
        while low + step <= most and self._same(i, j, low + step):
            low += step
            step *= 2
        high = min(low + step - 1, most)
        while low < high:
            middle = (low + high + 1) // 2
            if self._same(i, j, middle):
                low = middle
            else:
                high = middle - 1
        if i < begin <= i + low and words[i + size : begin] == words[j + size : begin + j - i]:
            return stop - i
        if words[i + size : i + low] == words[j + size : j + low] and (low == most or words[i + low] != words[j + low]):
            return low
        while size < most and words[i + size] == words[j + size]:  # two stretches share a hash: count
            size += 1
        return size

    def left(self, i: int, j: int, most: int) -> int:
        """How many words before i equal those before j, up to ``most``."""
        words, size = self.words, 0
        most = min(most, i)
        while size < most and words[i - size - 1] == words[j - size - 1]:
            size += 1
        return size


def lyndon_ends(words: list[int], common: CommonExtensions) -> tuple[list[int], list[int]]:
    """For every place where its longest Lyndon word ends, under the order of the numbers and under the reverse.

    Scanned from the right: the word at i takes in the word that follows as long as the suffix at i is the smaller. Where two
    neighbours differ, one of the orders is settled at once. The end of the sequence is smaller than any word in both orders.
    """
    n = len(words)
    up, down = [n] * n, [n] * n
    rising, falling = [*words, -1], [*words, _END]  # the end, as either order has it
    b = words[-1]
    for i in range(n - 2, -1, -1):
        a = words[i]
        if a < b:
            down[i] = i + 1
            j = up[i + 1]
            c = rising[j]
            while a < c or (a == c and _smaller(words, common, i, j, n, False)):
                j = up[j]
                c = rising[j]
            up[i] = j
        elif a > b:
            up[i] = i + 1
            j = down[i + 1]
            c = falling[j]
            while a > c or (a == c and _smaller(words, common, i, j, n, True)):
                j = down[j]
                c = falling[j]
            down[i] = j
        else:
            j = i + 1
            while a < rising[j] or (a == rising[j] and _smaller(words, common, i, j, n, False)):
                j = up[j]
            up[i], j = j, i + 1
            while a > falling[j] or (a == falling[j] and _smaller(words, common, i, j, n, True)):
                j = down[j]
            down[i] = j
        b = a
    return up, down


def _smaller(words: list[int], common: CommonExtensions, i: int, j: int, n: int, reverse: bool) -> bool:
    """Is the suffix at i smaller than the one at j (i < j)?"""
    size = common.right(i, j)
    return j + size < n and (words[i + size] < words[j + size]) != reverse


def find_runs(words: list[int], least: int = LEAST_WORDS, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run with its least period, by start, then period. Words are numbers from 0.

    A run with ``power`` (2 at least) periods holds ``power`` - 1 roots one after another; the first of a chain of roots is extended.
    """
    n = len(words)
    if n < least:
        return []
    common, found, here, numbers = CommonExtensions(words), set(), np.arange(n), np.array(words)
    for ends in lyndon_ends(words, common):
        size = np.array(ends) - here
        chain = np.flatnonzero(here + (power - 1) * size <= n)
        for k in range(1, power - 1):
            further = chain + k * size[chain]
            chain = chain[(size[further] == size[chain]) & (numbers[further] == numbers[chain])]
        for i in chain.tolist():
            p = int(size[i])
            if i >= p and size[i - p] == p and words[i - p : i] == words[i : i + p]:
                continue  # the same run's root stands before
            start = i - common.left(i, i + p, p)
            length = i - start + p + common.right(i, i + p)
            if length >= max(least, power * p):
                found.add((start, length, p))
    return sorted(found)


def read_words(text: str) -> tuple[list[int], list[bytes]]:
    """(number of each word, the word of each number); numbers follow the first appearance. Long texts are read part by part."""
    raw, numbers, words = text.encode(), {}, []
    at = 0
    while at < len(raw):
        end = min(at + _PART, len(raw))
        if end < len(raw):  # a part ends at white space, or with the text
            space = _SPACE.search(raw, end)
            end = space.start() if space else len(raw)
        part = raw[at:end].split()
        for w in part:
            if w not in numbers:
                numbers[w] = len(numbers)
        words += [numbers[w] for w in part]
        at = end
    return words, list(numbers)


def collapsed(words: list[int], vocabulary: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds beyond its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = np.array(words)[np.cumsum(change[:-1]) == 0].tolist()
    else:
        kept = words
    return b" ".join([vocabulary[w] for w in kept])


_OUT = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(documents: DataFrame, least: int = LEAST_WORDS, power: int = LEAST_POWER) -> DataFrame:
    """(doc_id, runs, collapsed) of every document (doc_id, text); runs is an array of (start, length, period), words numbered from 0.

    Null and empty texts have no runs and an empty collapsed text; rows without doc_id and repeated rows are documents like any
    other. Other columns are left out. A task holds one text's words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, runs, texts = whole.slice(at, 256), [], []
                for text in batch.column(1).to_pylist():
                    words, vocabulary = read_words(text or "")
                    found = find_runs(words, least, power)
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(collapsed(words, vocabulary, found).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, _OUT), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, by crc32 of doc_id, repeat their words from some place on.

    Of a document with n words, h = crc32 of the decimal doc_id and g = h / 10 (whole): if h % 10 = 0, each word from a = g % n on
    becomes word a + (i - a) % p, where p = 1 + (n - a) / (3 + g % 8) (whole). Such a text is its words joined by one space. Documents
    without doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = documents.select("doc_id", "text", h.alias("h")).withColumns({
        "g": F.floor(F.col("h") / 10).cast("long"),
        "words": F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")),
    })
    n = F.size("words")
    chosen = chosen.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    chosen = chosen.withColumn("p", (F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    rest = n - F.col("a")
    repeated = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")).otherwise(F.col("text"))
    return chosen.select("doc_id", text.alias("text"))


def _digest(runs: Column) -> Column:
    line = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.sha2(F.array_join(line, ""), 256)


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent (ties: least start, then period), and digests of runs and collapsed text."""
    found = with_runs(planted(documents))
    # length * other period > other length * period compares the exponents exactly; runs come in order, so ties keep the first.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.expr("best.length * 1000 div best.period")).cast("long").alias("exponent_milli"),
        _digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs by pairs of equal words of a document at every distance: stretches of such pairs, the least distance of equal stretches.
ORACLE_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words, cast(doc_id as varchar) as s from documents),
h as (select doc_id, words, len(words) as n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(s) + 1), lambda k: ascii(substr(s, cast(k as integer), 1))::bigint)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) as h from d),
p as (select *, h // 10 as g, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from h),
q as (select *, 1 + (n - a) // (3 + g % 8) as p from p),
t as (select doc_id, n, case when a is null then words else list_transform(range(n), lambda i: words[case when i >= a then a + (i - a) % p else i end + 1]) end as words from q),
w as (select doc_id, n, unnest(words) as w, cast(generate_subscripts(words, 1) - 1 as bigint) as i from t),
e as (select x.doc_id, x.i, y.i - x.i as q from w x join w y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and (y.i - x.i) * 4 <= x.n),
s as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from e) group by doc_id, q, island),
r as (select doc_id, start, length, min(q) as period from s where length >= greatest(6, 4 * q) group by doc_id, start, length),
b as (select * from (select *, row_number() over (partition by doc_id order by cast(length as double) / period desc, start, period) as rn from r) where rn = 1),
l as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listing from r group by doc_id),
x as (select distinct r.doc_id, w.i from r join w on w.doc_id = r.doc_id and w.i >= r.start + r.period and w.i < r.start + r.length),
c as (select w.doc_id, string_agg(w.w, ' ' order by w.i) as text from w left join x on x.doc_id = w.doc_id and x.i = w.i where x.i is null group by w.doc_id)
select d.doc_id, coalesce(l.n_runs, 0) as n_runs, b.start, b.length, b.period, b.length * 1000 // b.period as exponent_milli, sha256(coalesce(l.listing, '')) as runs_sha256, sha256(coalesce(c.text, '')) as collapsed_sha256
from documents d left join l using (doc_id) left join b using (doc_id) left join c using (doc_id)"""
