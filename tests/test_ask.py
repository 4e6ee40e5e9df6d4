"""The query ask takes whole texts and every question."""

from ragloom.operators import answering, embedding
from ragloom.plans import catalog


def test_ask_takes_every_item_and_whole_texts(spark, tmp_path):
    documents = [(i, f"{i:04d} " + "word " * 279, "en", "s", 1400) for i in range(60)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"question {i}") for i in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["queryId"]: r for r in catalog.QUERIES["ask"](spark, str(tmp_path)).collect()}
    assert set(rows) == set(range(60))
    scored = {i for i in range(60) if i * 37 % 101 >= 30}
    assert {i for i, r in rows.items() if r["reason"] is None} == scored and {i for i in scored if i >= 40}
    assert all(rows[i]["inputTokens"] > 1400 / 4 for i in scored)
    assert {r["reason"] for i, r in rows.items() if i not in scored} == {"below_threshold"}


def make_model():
    tries = {}

    def model(system, user, cancel):
        tries[user] = tries.get(user, 0) + 1
        if "slow" in user:
            cancel.wait(60)
        if "once" in user and tries[user] == 1:
            raise embedding.TransientProviderError("busy", 1)
        if "never" in user:
            raise PermissionError("no key")
        if "blank" in user:
            return "  "
        return "See [S1]." if "plain" in user else ("See [S1] and [S9].", 100, 10)

    return model


def test_a_model_answers_and_fails_by_question(spark):
    names = ["plain", "counted", "once", "never", "blank", "slow", "none"]
    questions = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "queryId long, question string").repartition(1)
    results = spark.createDataFrame([(i, f"c{i}", 0.9, 0, "body", None, "T", "A", "p.md") for i in range(6)], "queryId long, chunkId string, score double, position long, text string, parentText string, documentTitle string, headingPath string, sourcePath string")
    rows = {names[r["queryId"]]: r for r in answering.ask(questions, results, model=make_model(), base_ms=1, most_ms=2, timeout_s=0.3, attempts=2).collect()}
    assert (rows["plain"]["answer"], rows["plain"]["cited"], rows["plain"]["costUsd"], rows["plain"]["error"]) == ("See [S1].", ["S1"], None, None)
    assert (rows["counted"]["inputTokens"], rows["counted"]["outputTokens"]) == (100, 10) and abs(rows["counted"]["costUsd"] - (100 * 0.75 + 10 * 3.75) / 1e6) < 1e-12
    assert rows["once"]["reason"] is None and rows["once"]["answer"].startswith("See")
    assert {n: rows[n]["reason"] for n in ("never", "blank", "slow", "none")} == {"never": "generation_failed", "blank": "generation_failed", "slow": "generation_failed", "none": "no_results"}
    assert all(rows[n]["answer"] == answering.NO_ANSWER and rows[n]["cited"] is None for n in ("never", "blank", "slow", "none"))
    assert "no key" in rows["never"]["error"] and "timed out" in rows["slow"]["error"] and rows["none"]["error"] is None
