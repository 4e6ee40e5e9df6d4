"""Chunks of a given structured document against given chunks, where RAGLOOM_GOLDEN names both files (document:chunks)."""

import json
import os

import pytest
from ragloom.operators import narrow

GOLDEN = os.environ.get("RAGLOOM_GOLDEN", "")


@pytest.mark.skipif(":" not in GOLDEN, reason="no golden files given")
def test_chunks_are_the_given_ones(spark):
    document, chunks = (json.load(open(p)) for p in GOLDEN.split(":"))
    df = spark.createDataFrame([(document["documentId"], document["bodyText"])], "documentId string, body string")
    found = {r["chunkId"]: r.asDict(recursive=True) for r in narrow.document_chunks(df).collect()}
    assert set(found) == {c["chunkId"] for c in chunks}
    for c in chunks:
        given = {"text": c["text"], **{k: v for k, v in c["metadata"].items() if k not in ("sourcePath", "documentTitle", "chunkedAt")}, **c["relationships"]}
        assert {k: found[c["chunkId"]][k] for k in given} == given
