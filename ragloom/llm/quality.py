"""Quality rules: fixed rules on word statistics, then robust multivariate outlier rejection within language and source.

The minimum-covariance-determinant estimate of each (lang, source) group is found by distributed concentration steps from three
deterministic starts (robust scales alone; correlations of squashed values; spatial signs). A step measures all rows of a group
against a centre and scatter, takes the closest ``support`` share (a histogram of distances, merged before the shuffle) and
re-estimates both from that share (sums, merged before the shuffle). After two steps the start with the least determinant is
carried on until its determinant no longer falls. A floor on each statistic's spread is added to the scatter (a regularised
determinant), as most texts have no symbol and no repeated line at all. No group is ever gathered, so a group that holds a
third of all rows is no different from the others.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import append_columns, lookup, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Transformed statistics that form the vector of a document, and the least spread each is granted.
FEATURES = {"f_length": 0.25, "f_word": 0.06, "f_symbol": 0.06, "f_dup": 0.15, "f_repeat": 0.15}
#: Distances are binned to 1/1024 of a natural logarithm to find the closest share of a group.
BINS_PER_LOG = 1024
#: Starts of the search.
STARTS = 3
#: Texts of more words find their repeated windows by sorting numbers, which takes less memory.
_MANY_WORDS = 2000


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, duplicate lines, words in repeated 5-word windows, lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    dup = full = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(_SPACE):
                full += 1
                dup += line in seen
                seen.add(line)
    else:
        full = int(n > 0)
    return n, chars, symbols, dup, _in_repeated_windows(words), full


def _in_repeated_windows(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found twice or more."""
    if len(words) < 6:
        return 0
    if len(words) <= _MANY_WORDS:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        found = Counter(windows)
        if len(found) == len(windows):
            return 0
        again = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    else:
        # Each window gets a number that equal windows share: numbers of pairs, of pairs of pairs, and of those with a fifth word.
        known: dict[bytes, int] = {}
        one = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        known.clear()
        rank = lambda x, y: np.unique(x * (y.max() + 1) + y, return_inverse=True)[1]
        two = rank(one[:-1], one[1:])
        four = rank(two[:-2], two[2:])
        five = rank(four[:-1], one[4:])
        again = np.bincount(five)[five] > 1
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(again), 1)
    np.add.at(inside, np.flatnonzero(again) + 5, -1)
    return int((np.cumsum(inside) > 0).sum())


def statistics(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """df with the five counts and n_lines; a null or empty text has zeros."""
    fields = [T.StructField(c, T.LongType()) for c in [*COUNTS, "n_lines"]]
    return append_columns(df, ["text"], fields, lambda: lambda texts: list(map(list, zip(*map(text_counts, texts)))) if texts else [[] for _ in fields], keep)


def base_failed() -> Column:
    """Under ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _features(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return df.withColumns(
        {
            "f_length": F.log1p(F.col("n_words").cast("double")),
            "f_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "f_symbol": share("n_symbols", "word_chars"),
            "f_dup": share("n_dup_lines", "n_lines"),
            "f_repeat": share("n_repeat_words", "n_words"),
        }
    )


def _moments(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """n, sums and products of the columns by group."""
    sums = [F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(names)]]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}{j}") for i in range(len(names)) for j in range(i, len(names))]
    return df.groupBy(*keys).agg(*sums)


def covariance(row, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) from a row of ``_moments``."""
    mean = np.array([getattr(row, f"s{i}") for i in range(p)]) / row.n
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = getattr(row, f"p{i}{j}") / row.n - mean[i] * mean[j]
    return mean, cov


def _correlation(cov: np.ndarray) -> np.ndarray:
    """Correlations, shrunk a little so that they can be inverted; a column that never varies is uncorrelated."""
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    out = 0.99 * cov / np.outer(spread, spread)
    np.fill_diagonal(out, 1.0)
    return out


_ESTIMATE = T.StructType([T.StructField("g", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType())), T.StructField("log_det", T.DoubleType())])


def _estimate(g: str, start: int, centre: np.ndarray, scatter: np.ndarray) -> list:
    return [g, start, centre.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])]


def _starts(scales: DataFrame) -> DataFrame:
    """Three estimates a group, all around its medians: uncorrelated, by squashed values (y), by spatial signs (z)."""
    p, floors = len(FEATURES), np.array(list(FEATURES.values()))

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                centre, spread = (np.array([getattr(row, f"{c}{i}") for i in range(p)]) for c in "md")
                _, both = covariance(row, 2 * p)
                for start, part in enumerate((np.eye(p), _correlation(both[:p, :p]), _correlation(both[p:, p:]))):
                    out.append(_estimate(row.g, start, centre, part * np.outer(spread, spread) + np.diag(floors**2)))
            yield type(pdf)(out, columns=_ESTIMATE.fieldNames())

    return scales.mapInPandas(run, _ESTIMATE)


def _estimates(moments: DataFrame, widen: float) -> DataFrame:
    """Centre, inverse scatter and its log determinant from moments by (g, start); the floors keep a statistic that never varies from deciding alone."""
    p, floors = len(FEATURES), np.array(list(FEATURES.values()))

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                mean, cov = covariance(row, p)
                out.append(_estimate(row.g, row.start, mean, cov * widen + np.diag(floors**2)))
            yield type(pdf)(out, columns=_ESTIMATE.fieldNames())

    return moments.mapInPandas(run, _ESTIMATE)


def _distance(centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance to an estimate."""
    p, names = len(FEATURES), list(FEATURES)
    d = [F.col(f) - centre[i] for i, f in enumerate(names)]
    total = None
    for i in range(p):
        for j in range(p):
            term = d[i] * d[j] * inverse[i * p + j]
            total = term if total is None else total + term
    return total


def _chi2_quantile(p: int, q: float) -> float:
    """Wilson-Hilferty approximation of the chi-squared quantile."""
    from statistics import NormalDist

    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def _widening(support: float) -> float:
    """From the scatter of the central share to that of the whole under normality."""
    p, q = len(FEATURES), _chi2_quantile(len(FEATURES), support)
    return support / (support - q ** (p / 2) * math.exp(-q / 2) / (2 ** (p / 2) * math.gamma(p / 2 + 1)))


def _concentrated(usable: DataFrame, estimates: DataFrame, sizes: DataFrame, support: float) -> DataFrame:
    """Estimates from the share of each group that is closest to its present ones. Ties at the edge all take part."""
    by_group = estimates.groupBy("g").agg(F.collect_list(F.struct("start", "centre", "inverse")).alias("e"))  # at most STARTS elements
    near = lookup(usable, written(by_group.join(sizes, "g"), "estimates"), "g", "size").select("g", *FEATURES, F.explode("e").alias("e"))
    measured = near.select("g", "e.start", *FEATURES, F.floor(F.log1p(_distance(F.col("e.centre"), F.col("e.inverse"))) * BINS_PER_LOG).alias("bin"))
    bins = measured.groupBy("g", "start", "bin").agg(F.count("*").alias("c"))
    up_to = Window.partitionBy("g", "start").orderBy("bin")
    edge = bins.withColumns({"cum": F.sum("c").over(up_to), "all": F.sum("c").over(Window.partitionBy("g", "start"))}).where(F.col("cum") >= support * F.col("all")).groupBy("g", "start").agg(F.min("bin").alias("edge"))
    edges = edge.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("start", "edge"))).alias("edges"))
    chosen = lookup(measured, written(edges.join(sizes, "g"), "edges"), "g", "size").where(F.col("bin") <= F.col("edges")[F.col("start")])
    return written(_estimates(_moments(chosen, ["g", "start"], list(FEATURES)), _widening(support)), "mcd")


def mcd_estimates(usable: DataFrame, support: float = 0.75, most_steps: int = 8, least_fall: float = 5e-3) -> DataFrame:
    """(g, centre, inverse, log_det): the estimate of each group of usable (g and the features) that has the least determinant."""
    sizes = written(usable.groupBy("g").agg(F.count("*").alias("size")), "sizes")
    middle = lambda columns, name: [F.percentile_approx(c, 0.5, 1000).alias(f"{name}{i}") for i, c in enumerate(columns)]
    medians = written(usable.groupBy("g").agg(*middle(FEATURES, "m")).join(sizes, "g"), "medians")
    off = lookup(usable, medians, "g", "size").select("g", *[F.abs(F.col(f) - F.col(f"m{i}")).alias(f"o{i}") for i, f in enumerate(FEATURES)])
    widths = off.groupBy("g").agg(*middle([f"o{i}" for i in range(len(FEATURES))], "o"))
    scale = [F.greatest(1.4826 * F.col(f"o{i}"), F.lit(floor)).alias(f"d{i}") for i, floor in enumerate(FEATURES.values())]
    scales = written(medians.join(widths.select("g", *scale), "g"), "scales")
    scaled = lookup(usable, scales, "g", "size").select("g", *[((F.col(f) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"x{i}") for i, f in enumerate(FEATURES)])
    length = F.sqrt(sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(1, len(FEATURES))), F.col("x0") * F.col("x0")))
    named = [F.tanh(f"x{i}").alias(f"y{i}") for i in range(len(FEATURES))] + [(F.col(f"x{i}") / F.greatest("length", F.lit(1e-9))).alias(f"z{i}") for i in range(len(FEATURES))]
    sums = _moments(scaled.withColumn("length", length).select("g", *named), ["g"], [f"{c}{i}" for c in "yz" for i in range(len(FEATURES))])
    estimates = written(_starts(scales.join(sums, "g")), "mcd")
    for _ in range(2):
        estimates = _concentrated(usable, estimates, sizes, support)
    best = F.min(F.struct("log_det", "start", "centre", "inverse")).alias("b")
    estimates = written(estimates.groupBy("g").agg(best).select("g", "b.start", "b.centre", "b.inverse", "b.log_det"), "mcd")
    for _ in range(most_steps):
        following = _concentrated(usable, estimates, sizes, support)
        fallen = following.join(estimates.select("g", F.col("log_det").alias("before")), "g").agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
        # A step that raises the regularised determinant (by the ties at its edge) is not taken.
        both = estimates.unionByName(following)
        estimates = written(both.groupBy("g").agg(best).select("g", "b.start", "b.centre", "b.inverse", "b.log_det"), "mcd")
        if fallen is None or fallen < least_fall:
            break
    return estimates.select("g", "centre", "inverse", "log_det")


def mcd_verdicts(df: DataFrame, support: float = 0.75, quantile: float = 0.99999, least_group: int = 50) -> DataFrame:
    """df (with counts) plus distance2 and outlier.

    Groups of fewer than ``least_group`` usable rows are judged by the estimate of all usable rows of their language, and those of
    languages with fewer by that of the whole corpus: five spreads and ten correlations cannot be told from a handful of rows.
    Null lang or source form their own group. Rows that fail the base rules take no part in the estimates. Where no row is usable,
    distance2 is null and outlier false. ``quantile`` is far out as the statistics have longer tails than a normal distribution.
    """
    df = written(df, "counts")  # the texts are read once
    own = F.concat_ws("/", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    base = _features(df).withColumns({"g_lang": F.concat(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")), F.lit("/")), "g_own": own, "bad": base_failed()})
    counted = written(base.groupBy("g_own", "g_lang").agg(F.count_if(~F.col("bad")).alias("own_size"), F.count("*").alias("rows")), "group-sizes")
    languages = counted.groupBy("g_lang").agg(F.sum("own_size").alias("lang_size"))
    judged_by = F.when(F.col("own_size") >= least_group, F.col("g_own")).when(F.col("lang_size") >= least_group, F.col("g_lang")).otherwise("")
    groups = written(counted.join(languages, "g_lang").select("g_own", judged_by.alias("g"), "rows"), "groups")
    base = lookup(base, groups, "g_own", "rows")
    # Every usable row takes part in each estimate that judges some row: of its group, its language and the corpus.
    base = written(base.select(*df.columns, *FEATURES, "g", "g_lang", "g_own", "bad"), "quality")
    wanted = written(groups.groupBy("g").agg(F.sum("rows").alias("rows")).withColumn("wanted", F.lit(True)), "wanted")
    spread = base.where("not bad").select(F.explode(F.array_distinct(F.array("g_own", "g_lang", F.lit("")))).alias("g"), *FEATURES)
    usable = written(lookup(spread, wanted, "g", "rows").where("wanted").drop("wanted"), "levels")
    estimates = written(wanted.select("g", "rows").join(mcd_estimates(usable, support), "g"), "estimates")
    measured = lookup(base, estimates, "g", "rows").withColumn("distance2", _distance(F.col("centre"), F.col("inverse")))
    outlier = F.coalesce(F.col("distance2") > _chi2_quantile(len(FEATURES), quantile), F.lit(False))
    return measured.select(*df.columns, "distance2", outlier.alias("outlier"))


def quality_rules(documents: DataFrame, **settings) -> DataFrame:
    """One row a document: doc_id, the five counts, base_failed, kept, distance2.

    Null and empty texts count as no words, so they fail the base rules. Repeated rows get repeated results. Other columns
    than doc_id, text, lang and source are not looked at.
    """
    counted = statistics(documents.select("doc_id", "text", "lang", "source"), keep=["doc_id", "lang", "source"])
    judged = mcd_verdicts(counted, **settings)
    return judged.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~F.col("outlier")).alias("kept"), "distance2")
