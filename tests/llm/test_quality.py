"""Quality rules: repeated windows by both ways, and the estimates against exhaustive search."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F
from ragloom.llm import common, quality


def test_repeated_windows_are_counted_alike_in_long_texts(monkeypatch):
    rng = random.Random(1)
    texts = [[str(rng.randint(0, k)).encode() for _ in range(rng.randint(0, 60))] for k in (1, 2, 3, 9) for _ in range(40)]
    short = [quality._in_repeated_windows(t) for t in texts]
    monkeypatch.setattr(quality, "_MANY_WORDS", 0)
    assert [quality._in_repeated_windows(t) for t in texts] == short and max(short) > 5 and min(short) == 0


def least_determinant(x, support, widen):
    """(log determinant, mean) of the best subset by trying every one."""
    floors, best = np.diag(np.array(list(quality.FEATURES.values())) ** 2), None
    for rows in itertools.combinations(range(len(x)), int(np.ceil(support * len(x)))):
        part = x[list(rows)]
        value = np.linalg.slogdet(np.cov(part.T, bias=True) * widen + floors)[1]
        if best is None or value < best[0]:
            best = value, part.mean(axis=0)
    return best


def test_estimates_have_the_least_determinant_of_all_subsets(spark):
    rng = np.random.default_rng(3)
    names, rows, data = list(quality.FEATURES), [], {}
    for g in ("a", "b", "c"):
        x = rng.normal(0, 1, (16, len(names))) @ rng.normal(0, 0.6, (len(names), len(names)))
        x[:4] = rng.normal(9, 0.3, (4, len(names)))  # a dense far cluster
        data[g] = x
        rows += [(g, *map(float, r)) for r in x]
    usable = spark.createDataFrame(rows, "g string, " + ", ".join(f"{n} double" for n in names))
    found = {r["g"]: r for r in quality.mcd_estimates(usable).collect()}
    for g, x in data.items():
        value, mean = least_determinant(x, 0.75, quality._widening(0.75))
        assert found[g]["log_det"] <= value + 0.05 and np.allclose(found[g]["centre"], mean, atol=0.2)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, g string, outlier string")


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_verdicts_match_a_plain_search_and_do_not_depend_on_broadcasts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(60, 200)), "en", "hot" if i % 3 else "cold", 1, "x", "y") for i in range(180)]
    rows += [(200 + i, "$$$ ### *** %% " * 40 + prose(rng, 100), "en", "hot", 1, "x", "y") for i in range(12)]
    rows += [(300, prose(rng, 90), None, None, 1, "x", "y"), (301, None, None, "hot", 1, "x", "y"), (None, prose(rng, 90), "en", None, 1, "x", "y"), (302, "a b c\n" * 50, "en", "hot", 1, "x", "y")]
    rows += [rows[0]] * 3
    docs = documents(spark, rows)
    verdicts = lambda: sorted((str(r["doc_id"]), r["kept"], round(r["distance2"] or 0, 3)) for r in quality.quality_rules(docs).collect())
    first = verdicts()
    assert len(first) == len(rows)
    kept = {k: v for k, v, _ in first}
    assert sum(kept[str(i)] for i in range(180)) >= 178 and not any(kept[str(200 + i)] for i in range(12)) and kept["300"] and kept["None"] and not kept["301"] and not kept["302"]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert verdicts() == first
    # Plain search on one machine: random starts, exact subsets.
    counted = quality._features(quality.statistics(docs, ["doc_id", "lang", "source"])).where(F.col("source") == "hot").where(~quality.base_failed()).toPandas()
    x, rand, best = counted[list(quality.FEATURES)].to_numpy(), np.random.default_rng(0), None
    floors, widen = np.diag(np.array(list(quality.FEATURES.values())) ** 2), quality._widening(0.75)
    for _ in range(40):
        part = x[rand.choice(len(x), 8, replace=False)]
        for _ in range(25):
            mean, scatter = part.mean(axis=0), np.cov(part.T, bias=True) * widen + floors
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
            part = x[np.argsort(d2)[: int(np.ceil(0.75 * len(x)))]]
        value = np.linalg.slogdet(scatter)[1]
        if best is None or value < best[0]:
            best = value, d2
    plain = dict(zip(counted["doc_id"], best[1] <= quality._chi2_quantile(5, 0.99999)))
    assert all(kept[str(int(i))] == bool(v) for i, v in plain.items())
