"""Archives to answers through the engine, with a provider of one's own and with the offline one."""

import hashlib
import zipfile

import pytest

from ragloom.config import ConfigError, Settings
from ragloom.engine import Engine
from ragloom.operators import embedding
from ragloom.sources.store import Collections


def make_provider():
    """Counts of a few words; answers in reverse order."""

    def provider(texts):
        words = ["install", "port", "volume", "network"]
        return [(i, [float(t.lower().count(w)) + 0.001 for w in words]) for i, t in reversed(list(enumerate(texts)))]

    return provider


@pytest.fixture
def archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "docs.zip", "w") as z:
        for name, body in {"install.md": "# Install\n\nHow to install it. Then install again.\n", "net/port.md": "---\ntitle: Ports\n---\n# P\n\nThe port of the network, a port.\n\n## More\n\nOne port each.\n", "volume.md": "# Volumes\n\nA volume keeps data; a volume is a folder.\n", "skip.txt": "no"}.items():
            z.writestr(name, body)
    return str(tmp_path)


def test_archives_to_answers(spark, archives, tmp_path):
    settings = Settings(embedding_provider="words", embedding_model="m", embedding_dimensions=4, expand_parents=True)
    engine = Engine(spark, Collections(spark, str(tmp_path / "store")), settings, make_provider())
    documents = engine.documents(archives)
    assert engine.summary(archives, documents).first().asDict() == {"totalEntries": 4, "matched": 3, "succeeded": 3, "failed": 0, "failures": []}
    chunks, path = engine.chunks(documents), str(tmp_path / "records")
    first = engine.embed(chunks, path).first()
    assert first["succeeded"] == first["attempted"] > 2 and first["failed"] == 0
    again = engine.embed(chunks, path).first()
    assert (again["attempted"], again["alreadyEmbedded"]) == (0, first["attempted"])
    assert engine.index(path, chunks).first()["attempted"] == first["attempted"]
    questions = spark.createDataFrame([(1, "which port?"), (2, "where is the volume"), (3, " ")], "queryId long, question string")
    found = engine.search(questions, top_k=1).collect()
    assert {r["queryId"]: (r["documentTitle"], r["sourcePath"]) for r in found} == {1: ("Ports", "net/port.md"), 2: ("Volumes", "volume.md")}
    answers = {r["queryId"]: r for r in engine.ask(questions).collect()}
    assert answers[1]["cited"] == ["S1"] and answers[3]["reason"] == "no_results"
    assert engine.search(questions, sourcePath="install.md").select("sourcePath").distinct().count() == 1


def test_offline_and_failing_providers(spark, archives, tmp_path):
    with pytest.raises(ConfigError):
        Engine(spark, Collections(spark, str(tmp_path / "s")), Settings(embedding_provider="words"))
    engine = Engine(spark, Collections(spark, str(tmp_path / "s")), Settings(embedding_dimensions=32))
    chunks, path = engine.chunks(engine.documents(archives)), str(tmp_path / "r")
    engine.embed(chunks, path)
    assert engine.index(path, chunks).first()["skippedFakeProvider"] > 0 and engine.store.read(engine.collection) is None

    def broken(texts):
        raise ValueError(hashlib.sha256(texts[0].encode()).hexdigest())

    engine = Engine(spark, Collections(spark, str(tmp_path / "b")), Settings(embedding_provider="words", embedding_dimensions=4), broken)
    with pytest.raises(embedding.FailureRatioExceeded):
        engine.embed(chunks, str(tmp_path / "none"))
