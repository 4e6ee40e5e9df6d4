"""Sections to chunks: packing by size, merging of small siblings, order, identities, links, overlap, parent chunks."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import folds, ids, text
from ragloom.functions.text import length_of

_BLANK = "\n\n"


def _expanded(blocks: Column, most: int, strategy: str) -> Column:
    """Blocks with over-long tables and lists cut at rows and items; table parts repeat the header. Others stay whole."""

    def parts(block: Column) -> Column:
        size = lambda c: length_of(c, strategy)
        whole = F.array(F.struct(block["type"].alias("type"), block["text"].alias("text"), size(block["text"]).alias("length")))

        def cut(units: Column, header: Column | None) -> Column:
            bins = folds.greedy_bins(F.transform(units, size), most, 0 if header is None else size(header))

            def joined(numbers: Column) -> Column:
                def one(k: Column) -> Column:
                    own = F.array_join(F.filter(units, lambda _, i: F.get(numbers, i) == k), "\n")
                    full = own if header is None else F.concat(header, F.lit("\n"), own)
                    return F.struct(block["type"].alias("type"), full.alias("text"), size(full).alias("length"))

                return F.transform(F.array_distinct(numbers), one)

            return F.flatten(F.transform(F.array(bins), joined))

        long = size(block["text"]) > most
        return F.when(long & (block["type"] == "table") & block["rows"].isNotNull(), cut(block["rows"], block["header"])).when(long & (block["type"] == "list") & block["items"].isNotNull(), cut(block["items"], None)).otherwise(whole)

    return F.flatten(F.transform(blocks, parts))


def own_pieces(sections: DataFrame, most: int, strategy: str = "approx-token") -> DataFrame:
    """sections with pieces: one for a section within ``most``, else greedy bins of its blocks (none without blocks)."""
    line = text.heading_line(F.col("level"), F.col("heading"))
    df = sections.withColumn("headingLine", line).withColumn("headingLength", length_of(F.col("headingLine"), strategy))
    plain = F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), length_of(b["text"], strategy).alias("length")))
    df = df.withColumn("plain", plain)
    total = lambda c, start: F.aggregate(F.transform(c, lambda b: b["length"].cast("long")), start.cast("long"), lambda s, x: s + x)
    df = df.withColumn("ownLength", total(F.col("plain"), F.col("headingLength"))).withColumn("over", F.col("ownLength") > most)
    df = df.withColumn("units", F.when(F.col("over"), _expanded(F.col("blocks"), most, strategy)).otherwise(F.col("plain")))
    df = df.withColumn("bins", F.when(F.col("over"), folds.greedy_bins(F.transform("units", lambda b: b["length"]), most, F.col("headingLength"))).otherwise(F.transform("units", lambda _: F.lit(0))))

    def piece(k: Column) -> Column:
        own = F.filter("units", lambda _, i: F.get(F.col("bins"), i) == k)
        body = F.array_join(F.transform(own, lambda b: b["text"]), _BLANK)
        full = F.when(F.col("headingLine") == "", body).otherwise(text.trim(F.concat("headingLine", F.lit(_BLANK), body)))
        return F.struct(
            k.alias("seq"),
            full.alias("text"),
            total(own, F.col("headingLength")).alias("length"),
            F.array_distinct(F.transform(own, lambda b: b["type"])).alias("types"),
            F.col("over").alias("wasSplit"),
            (F.col("over") & (F.size(own) == 1) & (F.get(own, F.lit(0))["length"] > most)).alias("exceedsMaxSize"),
        )

    numbers = F.when(F.col("over"), F.array_distinct("bins")).otherwise(F.array(F.lit(0)))
    return df.withColumn("pieces", F.transform(numbers, piece)).drop("headingLine", "headingLength", "plain", "units", "bins", "over", "ownLength")


def with_pieces(sections: DataFrame, most: int = 500, strategy: str = "approx-token") -> DataFrame:
    """Sections under a heading with their pieces, kept so that the documents are parsed once."""
    return own_pieces(sections.where("level > 0"), most, strategy).persist(StorageLevel.MEMORY_AND_DISK)


def ordered_pieces(sections: DataFrame, most: int = 500, least: int = 100, strategy: str = "approx-token") -> DataFrame:
    """Pieces of all sections under a heading, small siblings merged, in reading order (column sequenceIndex).

    The sections' pieces and places are read by several joins, so both are kept (memory, then disk; lost blocks are made anew).
    Release them with ``spark.catalog.clearCache()`` when the result is written. Sections that have pieces already are taken as
    they are.
    """
    df = sections if "pieces" in sections.columns else with_pieces(sections, most, strategy)
    only = F.get("pieces", F.lit(0))
    df = df.withColumn("eligible", (F.size("pieces") == 1) & ~F.coalesce(only["wasSplit"], F.lit(True)) & F.coalesce(only["length"] < least, F.lit(False)))
    member = F.struct("sectionIdx", "eligible", F.coalesce(only["length"], F.lit(0)).alias("length"))
    siblings = df.groupBy("documentId", "parentIdx").agg(F.sort_array(F.collect_list(member)).alias("s")).withColumn("g", folds.sibling_groups(F.col("s"), most))
    at = siblings.select("documentId", "parentIdx", F.posexplode(F.arrays_zip("s", "g")).alias("memberIdx", "m")).select("documentId", "parentIdx", "memberIdx", F.col("m.s.sectionIdx").alias("sectionIdx"), F.col("m.g").alias("group"))
    group = Window.partitionBy("documentId", "parentIdx", "group")
    at = at.withColumns({"leader": F.min("sectionIdx").over(group), "members": F.count("*").over(group)}).persist(StorageLevel.MEMORY_AND_DISK)
    placed = df.join(at.drop("parentIdx"), ["documentId", "sectionIdx"])
    # Order: for each ancestor its group's leader and its place, then the leader's own piece; arrays compare from the left.
    steps = placed.select("documentId", "sectionIdx", F.posexplode(F.concat("ancestors", F.array("sectionIdx"))).alias("depth", "at"))
    keys = steps.join(at.select("documentId", F.col("sectionIdx").alias("at"), "leader", "memberIdx"), ["documentId", "at"]).groupBy("documentId", "sectionIdx").agg(F.sort_array(F.collect_list(F.struct("depth", "leader", "memberIdx"))).alias("k"))
    placed = placed.join(keys, ["documentId", "sectionIdx"])
    placed = placed.withColumn("prefix", F.flatten(F.transform(F.slice("k", 1, F.size("k") - 1), lambda s: F.array(s["leader"], s["memberIdx"] + 1)))).drop("k")
    exploded = placed.select("documentId", "sectionIdx", "parentIdx", "group", "leader", "members", "heading", "headingPath", "prefix", F.explode("pieces").alias("p"))
    single = exploded.where("members = 1").select("documentId", "sectionIdx", "headingPath", "prefix", "leader", F.col("p.seq").alias("localSequenceIndex"), "p.text", "p.length", F.col("p.types").alias("contentTypes"), "p.wasSplit", F.lit(False).alias("wasMerged"), F.array().cast("array<string>").alias("mergedHeadings"), "p.exceedsMaxSize")
    runs = exploded.where("members > 1").groupBy("documentId", "parentIdx", "group").agg(F.sort_array(F.collect_list(F.struct("sectionIdx", "headingPath", "prefix", "leader", "heading", "p"))).alias("r"))
    first = F.get("r", F.lit(0))
    merged = runs.select(
        "documentId", first["sectionIdx"].alias("sectionIdx"), first["headingPath"].alias("headingPath"), first["prefix"].alias("prefix"), first["leader"].alias("leader"), F.lit(0).alias("localSequenceIndex"),
        F.array_join(F.transform("r", lambda x: x["p"]["text"]), _BLANK).alias("text"), F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + x["p"]["length"]).alias("length"),
        F.array_distinct(F.flatten(F.transform("r", lambda x: x["p"]["types"]))).alias("contentTypes"), F.lit(False).alias("wasSplit"), F.lit(True).alias("wasMerged"),
        F.transform(F.slice("r", 2, 2**30), lambda x: x["heading"]).alias("mergedHeadings"), F.lit(False).alias("exceedsMaxSize"),
    )
    both = single.unionByName(merged).withColumn("order", F.concat("prefix", F.array("leader", F.lit(0), "localSequenceIndex")))
    return both.withColumn("sequenceIndex", F.row_number().over(Window.partitionBy("documentId").orderBy("order")) - 1).drop("prefix", "leader", "order")


def linked(df: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """df with previousChunkId and nextChunkId: the neighbours' keys within the group, in order."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumns({"previousChunkId": F.lag(key).over(w), "nextChunkId": F.lead(key).over(w)})


def with_occurrence(df: DataFrame, begins: Column, group: str, path: str, order: str) -> DataFrame:
    """df with occurrence: how many pieces of the same path have begun before, in order."""
    w = Window.partitionBy(group, path).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("occurrence", F.greatest(F.sum(begins.cast("int")).over(w) - 1, F.lit(0)).cast("int"))


def overlapped(pieces: DataFrame, overlap: str, overlap_sentences: int = 1) -> Column:
    """Text of each piece with what continues it from the piece before in front."""
    continued = F.col("wasSplit") & (F.col("localSequenceIndex") > 0)
    if overlap == "heading-context":
        return F.when(continued, F.concat(F.lit('_(continued from "'), text.breadcrumb(F.col("headingPath")), F.lit('")_\n\n'), "text")).otherwise(F.col("text"))
    if overlap == "sentence-overlap":
        in_order = Window.partitionBy("documentId").orderBy("sequenceIndex")
        before, types = F.lag("text").over(in_order), F.lag("contentTypes").over(in_order)
        sentences = F.filter(F.split(before, r"(?<=[.!?])\s+"), lambda s: text.trim(s) != "")
        tail = F.array_join(F.slice(sentences, -F.least(F.lit(overlap_sentences), F.size(sentences)), F.lit(overlap_sentences)), " ")
        fits = continued & (F.element_at(types, -1) == "paragraph") & (F.get("contentTypes", F.lit(0)) == "paragraph") & (F.size(sentences) > 0)
        return F.when(fits, F.concat(tail, F.lit(_BLANK), "text")).otherwise(F.col("text"))
    if overlap == "none":
        return F.col("text")
    raise ValueError(f"unknown overlap strategy: {overlap}")


def child_chunks(pieces: DataFrame, overlap: str = "heading-context", overlap_sentences: int = 1) -> DataFrame:
    """Pieces with chunkId, contentHash, previous and next, and the overlap text in front."""
    df = with_occurrence(pieces.withColumn("pathKey", text.path_key(F.col("headingPath"))), F.col("localSequenceIndex") == 0, "documentId", "pathKey", "sequenceIndex")
    df = df.withColumns({"chunkId": ids.chunk_id(F.col("documentId"), F.lit("child"), F.col("pathKey"), F.col("occurrence"), F.col("localSequenceIndex")), "contentHash": ids.content_hash(F.col("text"))})
    df = linked(df.withColumn("chunkText", overlapped(df, overlap, overlap_sentences)), "chunkId", "documentId", "sequenceIndex")
    return df.drop("text").withColumnRenamed("chunkText", "text").drop("occurrence", "pathKey")


def parent_chunks(sections: DataFrame, most: int = 500, strategy: str = "approx-token") -> DataFrame:
    """A chunk for every section under a heading with the text of its whole subtree, in pre-order.

    Sections are dealt by document once; a subtree is a stretch of the document's sections.
    """
    own = sections.where("level > 0").select(
        "documentId", "sectionIdx", "subtree", "headingPath", text.path_key(F.col("headingPath")).alias("pathKey"), F.transform("blocks", lambda b: b["type"]).alias("types"),
        F.concat_ws(_BLANK, text.heading_line(F.col("level"), F.col("heading")), F.when(F.size("blocks") > 0, F.array_join(F.transform("blocks", lambda b: b["text"]), _BLANK))).alias("part"),
    )
    own = with_occurrence(own.repartition("documentId"), F.lit(True), "documentId", "pathKey", "sectionIdx")
    whole = own.groupBy("documentId").agg(F.sort_array(F.collect_list(F.struct("sectionIdx", "subtree", "headingPath", "pathKey", "occurrence", "part", "types"))).alias("r"))
    below = lambda name: F.transform(F.slice("r", F.col("at") + 1, F.col("s.subtree")), lambda x: x[name])
    df = whole.select("documentId", "r", F.posexplode("r").alias("at", "s")).select(
        "documentId", "s.sectionIdx", "s.headingPath", "s.pathKey", "s.occurrence", F.array_join(below("part"), _BLANK).alias("text"), F.array_distinct(F.flatten(below("types"))).alias("contentTypes")
    )
    df = df.withColumn("chunkId", ids.chunk_id(F.col("documentId"), F.lit("parent"), F.col("pathKey"), F.col("occurrence"), F.lit(0)))
    size = length_of(F.col("text"), strategy)
    return df.select("documentId", "sectionIdx", "headingPath", "occurrence", "chunkId", "text", "contentTypes", size.cast("long").alias("length"), (size > most).alias("exceedsMaxSize"), ids.content_hash(F.col("text")).alias("contentHash"))


def chunks(sections: DataFrame, most: int = 500, least: int = 100, strategy: str = "approx-token", overlap: str = "heading-context", overlap_sentences: int = 1, include_parents: bool = True) -> DataFrame:
    """All chunks of the sections: parents (sequenceIndex -1) and children, linked both ways."""
    sections = with_pieces(sections, most, strategy)
    children = child_chunks(ordered_pieces(sections, most, least, strategy), overlap, overlap_sentences)
    names = ["chunkId", "documentId", "chunkType", "headingPath", "contentTypes", "text", "length", "sequenceIndex", "localSequenceIndex", "wasSplit", "wasMerged", "mergedHeadings", "exceedsMaxSize", "contentHash", "parentChunkId", "childChunkIds", "previousChunkId", "nextChunkId"]
    none, nobody = F.lit(None).cast("string"), F.array().cast("array<string>")
    if not include_parents:
        return children.withColumns({"chunkType": F.lit("child"), "parentChunkId": none, "childChunkIds": nobody}).select(*names)
    parents = parent_chunks(sections, most, strategy)
    linked = children.join(parents.select("documentId", "sectionIdx", F.col("chunkId").alias("parentChunkId")), ["documentId", "sectionIdx"], "left")
    below = linked.groupBy("documentId", "sectionIdx").agg(F.transform(F.sort_array(F.collect_list(F.struct("sequenceIndex", "chunkId"))), lambda x: x["chunkId"]).alias("childChunkIds"))
    parents = parents.join(below, ["documentId", "sectionIdx"], "left").withColumn("childChunkIds", F.coalesce("childChunkIds", nobody))
    parents = parents.withColumns({"chunkType": F.lit("parent"), "sequenceIndex": F.lit(-1), "localSequenceIndex": F.lit(0), "wasSplit": F.lit(False), "wasMerged": F.lit(False), "mergedHeadings": nobody, "parentChunkId": none, "previousChunkId": none, "nextChunkId": none})
    return parents.select(*names).unionByName(linked.withColumns({"chunkType": F.lit("child"), "childChunkIds": nobody}).select(*names))


def chunk_statistics(sections: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per document: sections, split sections, merged sections, pieces."""
    counted = sections.where("level > 0").groupBy("documentId").agg(F.count("*").alias("sections"))
    made = pieces.groupBy("documentId").agg(
        F.count("*").alias("pieces"), F.count_distinct(F.when(F.col("wasSplit"), F.col("sectionIdx"))).alias("splitSections"), F.sum(F.when(F.col("wasMerged"), F.size("mergedHeadings")).otherwise(0)).alias("mergedSections")
    )
    return counted.join(made, "documentId", "left").na.fill(0)
