"""Text expressions: cleaning, lengths, anchors, titles, embedding inputs. All are Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space, inside a character class (fixed values).
SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Joins the headings of a path.
CRUMB = " › "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _has_astral(text: Column) -> Column:
    """Does the text hold characters of two UTF-16 units? Most texts are told by their lengths alone."""
    return ~_is_ascii(text) & text.rlike(r"[\x{10000}-\x{10FFFF}]")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.when(_has_astral(text), F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")).otherwise(F.length(text))


def utf16_prefix(text: Column, units: Column | int) -> Column:
    """The first UTF-16 code units of a text. A pair that the cut would part is left out."""
    units = F.lit(units) if isinstance(units, int) else units
    raw = F.encode(text, "UTF-16BE")
    parted = F.hex(F.substring(raw, 2 * units - 1, F.lit(1))).between("D8", "DB")
    cut = F.decode(F.substring(raw, F.lit(1), 2 * (units - parted.cast("int"))), "UTF-16BE")
    # A text has no more units than bytes, and one without astral characters as many as characters.
    return F.when(units <= 0, F.when(text.isNotNull(), "")).when(F.octet_length(text) <= units, text).when(_has_astral(text), F.when(utf16_length(text) <= units, text).otherwise(cut)).otherwise(F.substring(text, F.lit(1), units))


#: The same characters one by one.
_SPACES = "".join(chr(i) for i in [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def _rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES))


def _one_blank_line(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)


def clean(text: Column) -> Column:
    """Unix line ends, at most one blank line in a row, no white space around."""
    return let(F.replace(text, F.lit("\r\n"), F.lit("\n")), lambda t: trim(_one_blank_line(t)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != ""))


def length_of(text: Column, strategy: str = "approx-token") -> Column:
    """Size of a text by strategy: char, word, or approx-token (four characters a token)."""
    if strategy == "char":
        return utf16_length(text)
    if strategy == "word":
        return word_count(text)
    if strategy == "approx-token":
        return token_estimate(text)
    raise ValueError(f"unknown length strategy: {strategy}")


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4).cast("int")


def slug(text: Column) -> Column:
    """Anchor of a heading; empty where no ASCII letter or digit is left."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(text)), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def resolve_title(front_matter: Column, first_heading: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(front_matter, F.lit("")), F.nullif(first_heading, F.lit("")), path)


def resolve_language(lang: Column, language: Column, default: str = "en") -> Column:
    """``lang`` if present (even if unusable), else ``language``; unusable is the default."""
    return F.coalesce(F.nullif(F.coalesce(lang, language), F.lit("")), F.lit(default))


def heading_line(level: Column, text: Column) -> Column:
    return F.when(level == 0, "").otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))


def breadcrumb(path: Column) -> Column:
    """Texts of a heading path (array of structs with ``text``)."""
    return F.array_join(F.transform(path, lambda s: s["text"]), CRUMB)


def path_key(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: s["anchor"]), "/")


def normalise_input(text: Column) -> Column:
    """No white space at line ends, at most one blank line, none around."""

    def ends(t: Column) -> Column:
        last = F.right(t, F.lit(1))
        some = F.contains(t, F.lit(" \n")) | F.contains(t, F.lit("\t\n")) | last.isin(" ", "\t")
        return F.when(some, F.regexp_replace(t, r"[ \t]+(?=\n|\z)", "")).otherwise(t)

    return let(text, lambda t: let(ends(t), lambda u: trim(_one_blank_line(u))))


def truncate_words(text: Column, most_tokens: int) -> Column:
    """At most about ``most_tokens`` tokens, cut at white space: at the last in the allowed stretch, else at the next beyond it.

    Gives a struct (text, truncated). A text without white space stays whole but counts as truncated. Each step is computed once.
    """
    most = 4 * most_tokens
    def beyond(t: Column, size: Column) -> Column:
        after = F.regexp_instr(F.substring(t, size + 1, F.lit(2**30)), F.lit(rf"[{SPACE}]"))
        return let(after, lambda a: F.when(a > 0, _rstrip(F.substring(t, F.lit(1), size - 1 + a))).otherwise(t))

    def inside(t: Column, first: Column) -> Column:
        head = F.regexp_replace(first, rf"[{SPACE}][^{SPACE}]*\z", "")
        return let(head, lambda h: F.when((F.length(h) > 0) & (F.length(h) < F.length(first)), _rstrip(h)).otherwise(beyond(t, F.length(first))))

    def cut(t: Column) -> Column:
        long = utf16_length(t) > most
        whole = F.struct(t.alias("text"), F.when(t.isNotNull(), F.lit(False)).alias("truncated"))
        return F.when(long, let(utf16_prefix(t, most), lambda first: F.struct(inside(t, first).alias("text"), F.lit(True).alias("truncated")))).otherwise(whole)

    return let(text, cut)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a path pattern: ** (with one following slash), * and ? as usual."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            i += pattern.startswith("/", i)
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() or c in "_/" else "\\" + c)
            i += 1
    return rf"(?s)\A{out}\z"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def is_safe_entry(name: Column) -> Column:
    """False for absolute names, NUL bytes and names that climb out of the archive's root. ``zipdocs.is_safe_name`` says the same of one name."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda acc, p: F.struct(
            (acc["now"] + F.when(p.isin("", "."), 0).when(p == "..", -1).otherwise(1)).alias("now"),
            F.least(acc["least"], acc["now"] + F.when(p.isin("", "."), 0).when(p == "..", -1).otherwise(1)).alias("least"),
        ),
    )
    return ~name.rlike(r"\A[/\\]") & ~name.contains("\0") & (depth["least"] >= 0)
