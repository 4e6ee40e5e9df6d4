"""Secret scans: patterns of known kinds, and strings whose sliding-window entropy is high for their character class.

Everything is a DataFrame expression over one row, so the scan is a single narrow stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern and order of the base spans (fixed values).
BASE_KINDS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Character classes of the entropy scan: alphabet, least candidate length (also the window), bits a character that count as random.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", r"(?<![A-Za-z0-9+/_=-])[0-9a-fA-F]{16,}(?![A-Za-z0-9+/_=-])", 16, 2.8),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.7),
}
#: Candidates that are never secrets: plain words (perhaps hyphenated, or paths of words), numbers, and stated placeholders.
ALLOW = r"^[A-Za-z]?[a-z]+(?:[-_/=+][A-Za-z]?[a-z]+)*[-_/=+]*$|^[A-Z]+(?:[-_/=+][A-Z]+)*[-_/=+]*$|^[0-9+/_=-]+$|(?i)example|placeholder|x{6,}"

#: Long lists of matches are folded in blocks of so many, as a fold copies what it has gathered at every step.
_BLOCK = 64
#: Counters of five bits each that share one number.
_PACKED = 12

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """The array in slices of _BLOCK elements."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))).otherwise(F.array(items))


def located(text: str, pattern: str, kind: str, rank: int) -> Column:
    """All leftmost non-overlapping matches in a string column, with code-point positions.

    The texts between the matches (split) and the matches themselves (extract) come from the same engine, so their running
    lengths are the positions.
    """
    parts = F.expr(f"arrays_zip(split({text}, {_quoted(pattern)}, -1), regexp_extract_all({text}, {_quoted(pattern)}, 0))")
    gap, size = lambda x: F.length(x["0"]), lambda x: F.coalesce(F.length(x["1"]), F.lit(0))

    def folded(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + gap(x) + size(x)))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(lengths, empty, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

        def span(acc: Column, x: Column) -> Column:
            start = acc["at"] + gap(x)
            found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + size(x)).alias("end"), F.lit(kind).alias("kind"), x["1"].alias("value"))
            return F.struct((start + size(x)).alias("at"), F.when(x["1"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], found)).alias("out"))

        none = F.array().cast(_SPAN)
        spans = lambda at: F.transform(blocks, lambda block, i: F.aggregate(block, F.struct(F.get(at, i).alias("at"), none.alias("out")), span, lambda acc: acc["out"]))
        return F.flatten(_let(starts, spans))

    return _let(parts, lambda p: F.when(F.size(p) > 1, _let(_blocks(p), folded)).otherwise(F.array().cast(_SPAN)))


def _outside(spans: Column, others: str) -> Column:
    """The spans that lie in none of the other spans (a sorted column). Only blocks of others that reach over a span are looked into."""
    reach = F.transform(_blocks(F.col(others)), lambda b: F.struct(b.alias("b"), F.get(b, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(b, lambda s: s["end"])).alias("hi")))
    inside = lambda s, blocks: F.exists(blocks, lambda k: (k["lo"] <= s["start"]) & (k["hi"] >= s["end"]) & F.exists(k["b"], lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"])))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), _let(reach, lambda blocks: F.filter(spans, lambda s: ~inside(s, blocks)))).otherwise(spans)


def _random_span(kind: str, span: Column) -> Column:
    """The candidate span if one of its windows reaches the class's entropy, else null.

    The fold keeps the count of each character in the window, twelve counts a number, and the sum of c * log2(c); a step adds one
    character and drops one, and changes the counts and that sum by these two alone.
    """
    alphabet, _, width, bits = CLASSES[kind]
    terms = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(width + 2)])
    most = (math.log2(width) - bits) * width
    codes = F.transform(F.split(span["value"], ""), lambda c: F.position(c, F.lit(alphabet)) - 1)
    place = lambda code: F.floor(code / _PACKED).cast("int")
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), code % _PACKED * 5)
    count = lambda n, code: F.call_function("shiftright", F.get(n, place(code)), code % _PACKED * 5).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def fold(code: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            full = i >= width
            new, old = F.get(code, i), F.get(code, i - width)
            before_new = count(acc["n"], new)
            before_old = count(acc["n"], old) + (old == new).cast("int")
            s = acc["s"] + F.get(terms, before_new + 1) - F.get(terms, before_new) + F.when(full, F.get(terms, before_old - 1) - F.get(terms, before_old)).otherwise(0.0)
            hit = (i >= width - 1) & (s <= most)
            nothing = F.lit(0).cast("long")
            counts = F.transform(acc["n"], lambda c, j: c + F.when(j == place(new), one(new)).otherwise(nothing) - F.when(full & (j == place(old)), one(old)).otherwise(nothing))
            return F.struct(counts.alias("n"), s.alias("s"), (acc["random"] | hit).alias("random"))

        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // _PACKED)).alias("n"), F.lit(0.0).alias("s"), F.lit(False).alias("random"))
        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), zero, step)

    return F.when(_let(codes, fold)["random"], span)


def _random_spans(kind: str) -> Column:
    return F.filter(F.transform(f"__{kind}", lambda s: _random_span(kind, s)), lambda s: s.isNotNull())


def _count(kind: str) -> Column:
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with base_spans and secret_spans, sorted by start and kind.

    Null texts count as empty and have no spans. A random string inside a base span is not reported again.
    """
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    found = [located("__t", pattern, kind, rank) for rank, (kind, pattern) in enumerate(BASE_KINDS.items())]
    long_enough = r"(?i)\A(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9+/_.=-]{6,}\z"
    found[0] = F.filter(found[0], lambda s: s["value"].rlike(long_enough))
    df = df.withColumn("base_spans", F.array_sort(F.concat(*found)))
    candidates = {f"__{kind}": F.filter(located("__t", pattern, kind, len(BASE_KINDS) + rank), lambda s: ~s["value"].rlike(ALLOW)) for rank, (kind, (_, pattern, _, _)) in enumerate(CLASSES.items())}
    df = df.withColumns(candidates).withColumns({name: _outside(F.col(name), "base_spans") for name in candidates})
    # A hexadecimal string is also base64 text: the narrower class speaks for it.
    hexadecimal, base64 = (_random_spans(kind) for kind in CLASSES)
    df = df.withColumn("__hex", hexadecimal).withColumn("__b64", base64).withColumn("__b64", _outside(F.col("__b64"), "__hex"))
    return df.withColumn("secret_spans", F.array_sort(F.concat("base_spans", "__hex", "__b64"))).drop("__t", "__hex", "__b64", *candidates)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    df = with_spans(documents.select("doc_id", "text")).drop("text")
    return df.select("doc_id", *map(_count, BASE_KINDS), F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("secret_spans").alias("spans"))


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every secret span of the text replaced by the mark; overlapping spans become one mark. Null texts stay null."""
    df = with_spans(df, text)
    source = F.col(f"`{text}`")

    def cut(acc: Column, s: Column) -> Column:
        """One more span of a block: what stands between is kept, the span marked unless it overlaps what is done."""
        between = F.substring(acc["text"], acc["at"] - acc["lo"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], between, F.lit(mark)))
        new = F.struct(acc["text"].alias("text"), acc["lo"].alias("lo"), s["end"].alias("at"), out.alias("out"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(new)

    def joined(blocks: Column) -> Column:
        # Each block of spans works on its own stretch of the text: from where the blocks before it end to where it ends.
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        zero = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("out"))
        reached = F.aggregate(ends, zero, lambda acc, e: F.struct(F.greatest(acc["at"], e).alias("at"), F.array_append(acc["out"], F.greatest(acc["at"], e)).alias("out")), lambda acc: acc["out"])

        def block(at: Column):
            def one(b: Column, i: Column) -> Column:
                lo, hi = F.get(at, i), F.get(at, i + 1)
                start = F.struct(F.substring(source, lo + 1, hi - lo).alias("text"), lo.alias("lo"), lo.alias("at"), F.lit("").alias("out"))
                return F.aggregate(b, start, cut, lambda acc: acc["out"])

            return one

        return _let(reached, lambda at: F.concat(F.array_join(F.transform(blocks, block(at)), ""), F.substring(source, F.element_at(at, -1) + 1, F.lit(2**31 - 1))))

    folded = _let(_blocks(F.col("secret_spans")), joined)
    return df.withColumn(text, F.when(F.size("secret_spans") > 0, folded).otherwise(source)).drop("base_spans", "secret_spans")
