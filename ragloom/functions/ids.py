"""Content-addressed identities: equal content gives equal ids on every run."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix hashed into point ids (fixed value).
POINT_NAMESPACE = "f47ee6f2-30c1-4b1e-9e17-embedding-id-v5"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(path: Column) -> Column:
    return F.sha2(path, 256)


def chunk_id(document: Column, kind: Column, key: Column, occurrence: Column, sequence: Column) -> Column:
    return F.sha2(F.concat_ws("::", document, kind, key, occurrence.cast("string"), sequence.cast("string")), 256)


def embedding_id(chunk: Column, text_hash: Column, provider: Column, model: Column, version: Column, dimensions: Column) -> Column:
    return F.sha2(F.concat_ws("::", chunk, text_hash, provider, model, version, dimensions.cast("string")), 256)


def point_id(embedding: Column) -> Column:
    """Version-5-shaped UUID of an embedding id."""
    h = F.sha1(F.concat(F.lit(POINT_NAMESPACE), embedding))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def collection_names(domain: Column, provider: Column, model: Column, dimensions: Column, version: Column) -> Column:
    """``collection_name`` of each row."""
    raw = F.concat(domain, F.lit("__"), provider, F.lit("_"), model, F.lit("_"), dimensions.cast("string"), F.lit("d_v"), version)
    return F.regexp_replace(F.lower(raw), "[^a-z0-9_]", "_")


def collection_name(domain: str, provider: str, model: str, dimensions: int, version: str) -> str:
    return re.sub(r"[^a-z0-9_]", "_", f"{domain}__{provider}_{model}_{dimensions}d_v{version}".lower())
