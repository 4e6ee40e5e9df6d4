"""Documents to linked chunks in one narrow pass: what ``chunking`` says with joins and windows, done for one document at a time.

All that decides a chunk (sizes, bins, merging, order, identities, links, overlap, the parents' texts) lies within its document, so a
task needs nothing but the rows it reads: no shuffle, nothing kept. A task holds one document and its chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ragloom.functions.text import CRUMB, SPACE
from ragloom.operators.markdown import section_tree

_BLANK = "\n\n"
#: Characters of chunk texts that one batch holds at most (one document's chunks stand together).
BATCH_CHARS = 4 << 20
_SPACES = re.compile(f"[{SPACE}]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")
_SEGMENTS = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("anchor", pa.string())]))
_STRINGS = pa.list_(pa.string())
_KINDS = {
    "chunkId": pa.string(), "documentId": pa.string(), "chunkType": pa.string(), "headingPath": _SEGMENTS, "contentTypes": _STRINGS, "text": pa.string(), "length": pa.int64(), "sequenceIndex": pa.int32(), "localSequenceIndex": pa.int32(),
    "wasSplit": pa.bool_(), "wasMerged": pa.bool_(), "mergedHeadings": _STRINGS, "exceedsMaxSize": pa.bool_(), "contentHash": pa.string(), "parentChunkId": pa.string(), "childChunkIds": _STRINGS, "previousChunkId": pa.string(), "nextChunkId": pa.string(), "error": pa.string(),
}
CHUNKS = (
    "chunkId string, documentId string, chunkType string, headingPath array<struct<level:int,text:string,anchor:string>>, contentTypes array<string>, text string, length long, sequenceIndex int, localSequenceIndex int, "
    "wasSplit boolean, wasMerged boolean, mergedHeadings array<string>, exceedsMaxSize boolean, contentHash string, parentChunkId string, childChunkIds array<string>, previousChunkId string, nextChunkId string, error string"
)


def _trim(text: str) -> str:
    return re.sub(rf"\A[{SPACE}]+|[{SPACE}]+\Z", "", text)


def _units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


#: Ways to measure a text. A function from text to a number may be given instead of a name.
MEASURES: dict[str, Callable[[str], int]] = {
    "char": _units,
    "word": lambda t: sum(1 for w in _SPACES.split(t) if w),
    "approx-token": lambda t: -(-_units(t) // 4),
}


def _distinct(values: Iterator[str]) -> list[str]:
    return list(dict.fromkeys(values))


def _digest(*parts: object) -> str:
    return hashlib.sha256("::".join(map(str, parts)).encode()).hexdigest()


@dataclass
class Rules:
    """How chunks are made; ``measure`` gives a text's size, ``plain`` the text as it is measured, hashed and given out."""

    most: int = 500
    least: int = 100
    measure: Callable[[str], int] = MEASURES["approx-token"]
    overlap: str = "heading-context"
    overlap_sentences: int = 1
    parents: bool = True
    plain: Callable[[str], str] = str

    def size(self, text: str) -> int:
        return self.measure(self.plain(text))


def _bins(sizes: list[int], most: int, initial: int) -> list[list[int]]:
    """Places of the elements of each bin: a bin closes when it has something and the next element would pass ``most``."""
    out: list[list[int]] = []
    held = initial
    for i, size in enumerate(sizes):
        if not out or held + size > most:
            out.append([])
            held = initial
        out[-1].append(i)
        held += size
    return out


def _units_of(block: dict, rules: Rules) -> list[tuple[str, str, int]]:
    """(type, text, size) of a block; a table or list over the limit is cut at its rows or items, tables repeating the header."""
    kind, size = block["type"], rules.size(block["text"])
    rows = block["rows"] if kind == "table" else block["items"] if kind == "list" else None
    if size <= rules.most or rows is None:
        return [(kind, block["text"], size)]
    header = block["header"] if kind == "table" else None
    out = []
    for places in _bins([rules.size(r) for r in rows], rules.most, 0 if header is None else rules.size(header)):
        text = "\n".join(rows[i] for i in places)
        text = text if header is None else f"{header}\n{text}"
        out.append((kind, text, rules.size(text)))
    return out


def _pieces(section: dict, rules: Rules) -> list[dict]:
    line = "#" * section["level"] + " " + section["text"]
    start = rules.size(line)
    units = [(b["type"], b["text"], rules.size(b["text"])) for b in section["blocks"]]
    over = start + sum(u[2] for u in units) > rules.most
    if over:
        units = [u for b in section["blocks"] for u in _units_of(b, rules)]
    out = []
    for seq, places in enumerate(_bins([u[2] for u in units], rules.most, start) if over else [list(range(len(units)))]):
        own = [units[i] for i in places]
        body = _BLANK.join(u[1] for u in own)
        out.append({
            "seq": seq, "text": rules.plain(_trim(line + _BLANK + body)), "length": start + sum(u[2] for u in own), "types": _distinct(u[0] for u in own),
            "wasSplit": over, "exceeds": over and len(own) == 1 and own[0][2] > rules.most,
        })
    return out


def _ordered(sections: list[dict], rules: Rules) -> list[dict]:
    """Pieces in reading order; neighbouring small siblings are one piece, which stands where the first of them does."""
    pieces = {s["idx"]: _pieces(s, rules) for s in sections}
    siblings: dict[int, list[dict]] = {}
    for s in sections:
        siblings.setdefault(s["parent"], []).append(s)
    groups, place = {}, {}
    for members in siblings.values():
        run, size = [], 0
        for at, s in enumerate(members):
            own = pieces[s["idx"]]
            small = len(own) == 1 and not own[0]["wasSplit"] and own[0]["length"] < rules.least
            length = own[0]["length"] if own else 0
            if run and small and run_small and size + length <= rules.most:
                run.append(s)
                size += length
            else:
                run, size = [s], length
            run_small = small
            groups[s["idx"]], place[s["idx"]] = run, at
    out = []
    for s in sections:
        run = groups[s["idx"]]
        if run[0] is not s:
            continue
        key = [x for a in s["ancestors"] for x in (groups[a][0]["idx"], place[a] + 1)] + [s["idx"], 0]
        if len(run) == 1:
            out += [{"section": s, "key": [*key, p["seq"]], **p, "merged": []} for p in pieces[s["idx"]]]
        else:
            all_ = [pieces[m["idx"]][0] for m in run]
            out.append({
                "section": s, "key": [*key, 0], "seq": 0, "text": _BLANK.join(p["text"] for p in all_), "length": sum(p["length"] for p in all_), "types": _distinct(t for p in all_ for t in p["types"]),
                "wasSplit": False, "exceeds": False, "merged": [m["text"] for m in run[1:]],
            })
    return sorted(out, key=lambda p: p["key"])


def _overlapped(piece: dict, before: dict | None, rules: Rules) -> str:
    if rules.overlap == "none" or not piece["wasSplit"] or piece["seq"] == 0:
        return piece["text"]
    if rules.overlap == "heading-context":
        return f'_(continued from "{CRUMB.join(x["text"] for x in piece["section"]["path"])}")_{_BLANK}{piece["text"]}'
    sentences = [s for s in _SENTENCE.split(before["text"]) if _trim(s)] if before else []
    if sentences and before["types"][-1:] == ["paragraph"] and piece["types"][:1] == ["paragraph"]:
        return " ".join(sentences[-rules.overlap_sentences :]) + _BLANK + piece["text"]
    return piece["text"]


def chunks_of(document_id: str, body: str, rules: Rules) -> list[dict]:
    """Parents in pre-order (sequenceIndex -1), then children in reading order, linked both ways."""
    sections = [s for s in section_tree(body) if s["level"]]
    path_key = {s["idx"]: "/".join(x["anchor"] for x in s["path"]) for s in sections}
    parents: dict[int, dict] = {}
    if rules.parents:
        parts = [_BLANK.join(["#" * s["level"] + " " + s["text"], *([_BLANK.join(b["text"] for b in s["blocks"])] if s["blocks"] else [])]) for s in sections]
        begun: dict[str, int] = {}
        for at, s in enumerate(sections):
            text = rules.plain(_BLANK.join(parts[at : at + s["subtree"]]))
            size, occurrence = rules.measure(text), begun.get(path_key[s["idx"]], 0)
            begun[path_key[s["idx"]]] = occurrence + 1
            parents[s["idx"]] = {
                "chunkId": _digest(document_id, "parent", path_key[s["idx"]], occurrence, 0), "documentId": document_id, "chunkType": "parent", "headingPath": s["path"], "contentTypes": _distinct(b["type"] for x in sections[at : at + s["subtree"]] for b in x["blocks"]),
                "text": text, "length": size, "sequenceIndex": -1, "localSequenceIndex": 0, "wasSplit": False, "wasMerged": False, "mergedHeadings": [], "exceedsMaxSize": size > rules.most, "contentHash": _digest(text),
                "parentChunkId": None, "childChunkIds": [], "previousChunkId": None, "nextChunkId": None,
            }
    children, begun, before = [], {}, None
    for sequence, p in enumerate(_ordered(sections, rules)):
        s = p["section"]
        key = path_key[s["idx"]]
        begun[key] = begun.get(key, 0) + (p["seq"] == 0)
        chunk = {
            "chunkId": _digest(document_id, "child", key, max(begun[key] - 1, 0), p["seq"]), "documentId": document_id, "chunkType": "child", "headingPath": s["path"], "contentTypes": p["types"], "text": _overlapped(p, before, rules), "length": p["length"],
            "sequenceIndex": sequence, "localSequenceIndex": p["seq"], "wasSplit": p["wasSplit"], "wasMerged": bool(p["merged"]), "mergedHeadings": p["merged"], "exceedsMaxSize": p["exceeds"], "contentHash": _digest(p["text"]),
            "parentChunkId": parents[s["idx"]]["chunkId"] if rules.parents else None, "childChunkIds": [], "previousChunkId": children[-1]["chunkId"] if children else None, "nextChunkId": None,
        }
        if children:
            children[-1]["nextChunkId"] = chunk["chunkId"]
        if rules.parents:
            parents[s["idx"]]["childChunkIds"].append(chunk["chunkId"])
        children.append(chunk)
        before = p
    return [*parents.values(), *children]


STATISTICS = "documentId string, sections long, pieces long, splitSections long, mergedSections long, error string"


def document_statistics(documents: DataFrame, most: int = 500, least: int = 100, strategy: str = "approx-token", plain: Callable[[str], str] = str) -> DataFrame:
    """One row a document (documentId, body) with a section under a heading: sections, pieces, split sections, merged sections.

    The pieces are counted where they are made, so no text leaves a task. A document that cannot be chunked has ``error`` and no counts.
    """
    rules = Rules(most, least, MEASURES[strategy], plain=plain)
    names = [f.split()[0] for f in STATISTICS.split(", ")]

    def one(document_id: str | None, body: str | None) -> tuple | None:
        try:
            sections = [s for s in section_tree(body) if s["level"]] if body and body.strip() else []
            made = _ordered(sections, rules)
        except Exception as error:  # noqa: BLE001 - whatever a document does to the parser fails that document only
            return document_id, None, None, None, None, f"{type(error).__name__}: {error}"
        split = {p["section"]["idx"] for p in made if p["wasSplit"]}
        return (document_id, len(sections), len(made), len(split), sum(len(p["merged"]) for p in made), None) if sections else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for d, b in zip(batch.column(0), batch.column(1), strict=True) if (r := one(d.as_py(), b.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k in (0, 5) else pa.int64()) for k in range(6)], names=names)

    return documents.select("documentId", documents["body"].cast("string")).mapInArrow(run, STATISTICS)


def document_chunks(
    documents: DataFrame, most: int = 500, least: int = 100, strategy: str | Callable[[str], int] = "approx-token", overlap: str = "heading-context", overlap_sentences: int = 1, include_parents: bool = True, keep: tuple[str, ...] = (),
    plain: Callable[[str], str] = str,
) -> DataFrame:
    """Chunks of (documentId, body), with the columns that ``keep`` names carried along; null and blank bodies have none.

    A document that cannot be chunked gives one row with ``error`` and no chunkId; the others are not touched by it. ``strategy`` is a
    name of MEASURES or a function from text to a size. Rows that share a documentId are chunked each on its own. ``plain`` is applied to
    blocks before they are measured, and to the texts of chunks once they are trimmed (``markdown.unmarked`` for lines of plain text).
    """
    if isinstance(strategy, str) and strategy not in MEASURES:
        raise ValueError(f"unknown length strategy: {strategy}")
    if overlap not in ("none", "heading-context", "sentence-overlap"):
        raise ValueError(f"unknown overlap strategy: {overlap}")
    rules = Rules(most, least, MEASURES.get(strategy, strategy) if isinstance(strategy, str) else strategy, overlap, overlap_sentences, include_parents, plain)
    names = list(_KINDS)

    def one(document_id: str | None, body: str | None) -> list[dict]:
        if not body or not body.strip():
            return []
        try:
            return chunks_of(document_id, body, rules)
        except Exception as error:  # noqa: BLE001 - whatever a document does to the parser fails that document only
            return [{"documentId": document_id, "error": f"{type(error).__name__}: {error}"}]

    def made(batch: pa.RecordBatch, rows: list[dict], owners: list[int]) -> pa.RecordBatch:
        at = pa.array(owners, pa.int64())
        return pa.RecordBatch.from_arrays([*[pa.array([r.get(c) for r in rows], k) for c, k in _KINDS.items()], *[c.take(at) for c in batch.columns[2:]]], names=[*names, *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners, size = [], [], 0
            for at, (document_id, body) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                found = one(document_id.as_py(), body.as_py())
                rows += found
                owners += [at] * len(found)
                size += sum(len(r.get("text") or "") for r in found)
                if size > BATCH_CHARS:
                    yield made(batch, rows, owners)
                    rows, owners, size = [], [], 0
            if rows:
                yield made(batch, rows, owners)

    carried = "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select("documentId", documents["body"].cast("string"), *keep).mapInArrow(run, CHUNKS + carried)

