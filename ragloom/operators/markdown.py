"""Markdown blocks by line ranges: what the chunker and the outline need of a document, and no rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})(.*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r" {0,3}>")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*))?$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_REFERENCE = re.compile(r" {0,3}\[[^\]]+\]:[ \t]*\S+")
_LINK = re.compile(r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)")
_NOTE = re.compile(r"\s*(?:\[!(?:note|warning|important|caution|tip)\]|\*{0,2}(?:note|warning|important|caution|tip)\b)", re.IGNORECASE)
_SLUG = re.compile(r"[^a-z0-9]+")
#: Quotes and lists nested deeper are not looked into.
MOST_NESTED = 100


#: Stands at both ends of a line of plain text, so that Markdown reads it as a paragraph whatever it holds, and no trimming shortens it.
MARK = "\x01"


def marked(line: Column) -> Column:
    return F.concat(F.lit(MARK), line, F.lit(MARK))


def unmarked(text: str) -> str:
    """The text with a mark less at each end of its lines, where there is one."""
    return f"\n{text}\n".replace(f"\n{MARK}", "\n").replace(f"{MARK}\n", "\n")[1:-1] if MARK in text else text


#: Rows and bytes of texts that a task parses at a time (one longer text stands alone).
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def small_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes of a text column: what is made of a slice can go before the next is read."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at = held = 0
        for i, size in enumerate(sizes):
            if i > at and (i - at == SLICE_ROWS or held + size > SLICE_BYTES):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        if at < len(sizes):
            yield batch.slice(at)


def anchor_of(text: str) -> str:
    return _SLUG.sub("-", text.strip().lower()).strip("-")


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip(" "))


def _cells(row: str) -> int:
    return len(re.split(r"(?<!\\)\|", row.strip().strip("|")))


def _table_at(lines: list[str], i: int) -> bool:
    return i + 1 < len(lines) and "|" in lines[i] and bool(_DELIMITER.match(lines[i + 1])) and ("|" in lines[i + 1] or ":" in lines[i + 1]) and _cells(lines[i]) == _cells(lines[i + 1])


def _breaks_paragraph(lines: list[str], i: int) -> bool:
    line = lines[i]
    if _indent(line) >= 4:
        return False
    item = _ITEM.match(line)
    starts_list = bool(item and (item[4] or "").strip() and (not item[2][0].isdigit() or item[2][:-1] == "1"))
    return bool(_FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line)) or starts_list


def blocks(lines: list[str]) -> Iterator[dict]:
    """Top-level blocks: kind, start and end line, and what belongs to the kind."""
    i, n = 0, len(lines)
    while i < n:
        line, start = lines[i], i
        if not line.strip():
            i += 1
        elif _indent(line) >= 4:
            while i < n and (_indent(lines[i]) >= 4 or not lines[i].strip()):
                i += 1
            end = i
            while not lines[end - 1].strip():
                end -= 1
            yield {"kind": "indented", "start": start, "end": end}
        elif fence := _FENCE.match(line):
            close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
            i += 1
            while i < n and not close.match(lines[i]):
                i += 1
            yield {"kind": "fence", "start": start, "end": min(i + 1, n), "info": fence[2].strip(), "content": "".join(x + "\n" for x in lines[start + 1 : i])}
            i += 1
        elif atx := _ATX.match(line):
            i += 1
            yield {"kind": "heading", "start": start, "end": i, "level": len(atx[1]), "text": (atx[2] or "").strip()}
        elif _RULE.match(line):
            i += 1
            yield {"kind": "rule", "start": start, "end": i}
        elif _QUOTE.match(line):
            while i < n and lines[i].strip() and (_QUOTE.match(lines[i]) or not _breaks_paragraph(lines, i)):
                i += 1
            yield {"kind": "quote", "start": start, "end": i, "inner": [re.sub(r"^ {0,3}> ?", "", x) for x in lines[start:i]]}
        elif _ITEM.match(line):
            i, items = _list(lines, i)
            yield {"kind": "list", "start": start, "end": i, "items": items}
        elif _table_at(lines, i):
            i += 2
            while i < n and lines[i].strip() and not _breaks_paragraph(lines, i):
                i += 1
            yield {"kind": "table", "start": start, "end": i}
        else:
            i += 1
            setext = None
            while i < n and lines[i].strip() and not _table_at(lines, i):
                setext = _SETEXT.match(lines[i]) if _indent(lines[i]) < 4 else None
                if setext or _breaks_paragraph(lines, i):
                    break
                i += 1
            text = "\n".join(x.strip() for x in lines[start:i])
            if setext:
                i += 1
                yield {"kind": "heading", "start": start, "end": i, "level": 1 if setext[1][0] == "=" else 2, "text": text}
            elif not all(_REFERENCE.match(x) for x in lines[start:i]):
                yield {"kind": "paragraph", "start": start, "end": i, "text": text}


def _list(lines: list[str], i: int) -> tuple[int, list[tuple[int, int, list[str]]]]:
    """(line after the list, items): a list takes the blank lines that follow it, as its items do."""
    mark, n, items = _ITEM.match(lines[i])[2][-1], len(lines), []
    while i < n:
        item = _ITEM.match(lines[i])
        if not item or item[2][-1] != mark or _RULE.match(lines[i]):
            break
        gap = len((item[3] or " ").expandtabs(4))
        inside = len(item[1]) + len(item[2]) + (gap if gap <= 4 and (item[4] or "").strip() else 1)
        start, blank, inner = i, False, [item[4] or ""]
        i += 1
        while i < n:
            if not lines[i].strip():
                blank = True
            elif _indent(lines[i]) >= inside:
                blank = False
            elif blank or _breaks_paragraph(lines, i) or _ITEM.match(lines[i]):
                break
            inner.append(lines[i][min(inside, _indent(lines[i])) :])
            i += 1
        items.append((start, i, inner))
    return i, items


def section_tree(body: str) -> list[dict]:
    """Sections in pre-order, the root (level 0, text before the first heading) first, each with parent, path, blocks and subtree:
    how many sections from it on are itself and what lies below it."""
    lines = body.split("\n")
    sections = [{"idx": 0, "parent": -1, "level": 0, "text": "", "path": [], "ancestors": [], "blocks": []}]
    stack = [sections[0]]
    for block in blocks(lines):
        text = "\n".join(lines[block["start"] : block["end"]])
        kind = block["kind"]
        if kind == "heading":
            while len(stack) > 1 and stack[-1]["level"] >= block["level"]:
                stack.pop()
            up = stack[-1]
            own = {"level": block["level"], "text": block["text"], "anchor": anchor_of(block["text"])}
            section = {"idx": len(sections), "parent": up["idx"], "level": block["level"], "text": block["text"], "path": [*up["path"], own], "ancestors": [*up["ancestors"], *([up["idx"]] if up["level"] else [])], "blocks": []}
            sections.append(section)
            stack.append(section)
            continue
        out = {"type": None, "text": text, "language": None, "items": None, "header": None, "rows": None}
        if kind in ("fence", "indented"):
            out |= {"type": "code", "language": (block.get("info") or "").split(" ")[0] or None}
        elif kind == "table":
            out |= {"type": "table", "header": "\n".join(lines[block["start"] : block["start"] + 2]), "rows": lines[block["start"] + 2 : block["end"]]}
        elif kind == "list":
            out |= {"type": "list", "items": ["\n".join(lines[a:b]) for a, b, _ in block["items"]]}
        elif kind == "quote":
            first = next((x for x in block["inner"] if x.strip()), "")
            out["type"] = "note" if _NOTE.match(first) else "paragraph"
        elif kind == "paragraph":
            out["type"] = "paragraph"
        if out["type"]:
            stack[-1]["blocks"].append(out)
    for section in reversed(sections):
        section["subtree"] = section.get("subtree", 0) + 1
        if section["idx"]:
            up = sections[section["parent"]]
            up["subtree"] = up.get("subtree", 0) + section["subtree"]
    return sections


def outline(body: str) -> dict:
    """Headings (with parents), first level-1 heading, fenced code and links, nested blocks included.

    Blocks nested more than MOST_NESTED deep count as text.
    """
    headings: list[dict] = []
    codes: list[dict] = []
    links: list[str] = []
    stack: list[dict] = []

    def walk(lines: list[str], depth: int = 0) -> None:
        for block in blocks(lines) if depth <= MOST_NESTED else ():
            kind = block["kind"]
            if kind == "heading":
                while stack and stack[-1]["level"] >= block["level"]:
                    stack.pop()
                own = {"idx": len(headings), "parentIdx": stack[-1]["idx"] if stack else -1, "level": block["level"], "text": block["text"], "anchor": anchor_of(block["text"])}
                headings.append(own)
                stack.append(own)
            elif kind == "fence":
                codes.append({"language": block["info"].split(" ")[0], "content": block["content"], "position": len(codes)})
            elif kind == "quote":
                walk(block["inner"], depth + 1)
            elif kind == "list":
                for _, _, inner in block["items"]:
                    walk(inner, depth + 1)
            if kind in ("heading", "paragraph"):
                links.extend(_LINK.findall(block["text"]))
            elif kind == "table":
                links.extend(_LINK.findall("\n".join(lines[block["start"] : block["end"]])))

    walk(body.split("\n"))
    return {"headings": headings, "first_h1": next((h["text"] for h in headings if h["level"] == 1), None), "codeBlocks": codes, "links": links}


_SEGMENT = pa.struct([("level", pa.int32()), ("text", pa.string()), ("anchor", pa.string())])
_BLOCK = pa.struct([("type", pa.string()), ("text", pa.string()), ("language", pa.string()), ("items", pa.list_(pa.string())), ("header", pa.string()), ("rows", pa.list_(pa.string()))])
SECTIONS = (
    "documentId string, sectionIdx int, parentIdx int, level int, heading string, headingPath array<struct<level:int,text:string,anchor:string>>, ancestors array<int>, subtree int, "
    "blocks array<struct<type:string,text:string,language:string,items:array<string>,header:string,rows:array<string>>>"
)
OUTLINES = "headings array<struct<idx:int,parentIdx:int,level:int,text:string,anchor:string>>, firstH1 string, codeBlocks array<struct<language:string,content:string,position:int>>, links array<string>"


def sections(documents: DataFrame) -> DataFrame:
    """One row a section of (documentId, body). A null or blank body has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            rows = [(d, s) for d, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if body and body.strip() for s in section_tree(body)]
            pick = lambda key, kind: pa.array([s[key] for _, s in rows], kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.string()), pick("idx", pa.int32()), pick("parent", pa.int32()), pick("level", pa.int32()), pick("text", pa.string()), pick("path", pa.list_(_SEGMENT)), pick("ancestors", pa.list_(pa.int32())), pick("subtree", pa.int32()), pick("blocks", pa.list_(_BLOCK))],
                names=["documentId", "sectionIdx", "parentIdx", "level", "heading", "headingPath", "ancestors", "subtree", "blocks"],
            )

    return documents.select("documentId", F.col("body").cast("string")).mapInArrow(run, SECTIONS)


def outlines(documents: DataFrame) -> DataFrame:
    """documents (with a column body) with headings, firstH1, codeBlocks, links and outlineError. Their own columns stay.

    A document that cannot be parsed has an error and no outline; the others are not touched by it.
    """
    heading = pa.struct([("idx", pa.int32()), ("parentIdx", pa.int32()), *list(_SEGMENT)])
    code = pa.struct([("language", pa.string()), ("content", pa.string()), ("position", pa.int32())])
    keep = [c for c in documents.columns if c not in ("headings", "firstH1", "codeBlocks", "links", "outlineError")]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    at = keep.index("body")

    def one(body: str | None) -> tuple[dict, str | None]:
        try:
            return outline(body or ""), None
        except Exception as error:  # noqa: BLE001 - whatever a document does to the parser fails that document only
            return {"headings": [], "first_h1": None, "codeBlocks": [], "links": []}, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            found = [one(body) for body in batch.column(at).to_pylist()]
            made = [pa.array([x["headings"] for x, _ in found], pa.list_(heading)), pa.array([x["first_h1"] for x, _ in found], pa.string()), pa.array([x["codeBlocks"] for x, _ in found], pa.list_(code)), pa.array([x["links"] for x, _ in found], pa.list_(pa.string())), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*keep, "headings", "firstH1", "codeBlocks", "links", "outlineError"])

    return documents.select(*keep).mapInArrow(run, f"{schema}, {OUTLINES}, outlineError string")
