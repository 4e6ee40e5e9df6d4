"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent.

Subwords are runs of one to four code points inside a word with its edges marked. After training the embedding table times the
output weights gives one small table of logits a bucket, so a whole text costs a few array operations per code point. A
text's confidence is the calibrated probability of its language times the share of its subwords that training has seen; texts
less confident than nearly all correctly told texts that were held back are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import append_columns, held_out, learnable

#: Texts that training takes at most, each as a whole: of one language, of all together, and what each language may have in any case.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, LEAST_PER_LANGUAGE = 800, 20_000, 10
UNDETERMINED = "und"
#: Subwords have numbers up to 2^20; their upper 15 bits are the bucket of the embedding.
_CODES, _SHIFT, _BUCKETS, _DIM, _LONGEST = 1 << 20, 5, 1 << 15, 16, 4
#: Share of held-back correct predictions that rejection may cost, and the margin below their confidence.
_LOST, _MARGIN = 0.002, 0.9
#: Code points that are worked on at a time.
_CHUNK = 1 << 18


@dataclass
class LanguageModel:
    """languages; logits: a row a bucket; bias; temperature; seen: subwords that training met; threshold: confidence under which a text is rejected."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    seen: np.ndarray
    threshold: float


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subwords(text: str) -> Iterator[np.ndarray]:
    """Numbers of all subwords of the whole text, in pieces of bounded size: each subword once, in the piece in which it ends."""
    text = f" {text.lower()} "
    for at in range(0, len(text), _CHUNK):
        before = min(at, _LONGEST - 1)
        yield _numbers(np.frombuffer(text[at - before : at + _CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32), before)


def _numbers(codes: np.ndarray, before: int) -> np.ndarray:
    """Numbers of the subwords that end after the first ``before`` code points."""
    gap = (codes <= 64) | ((codes >= 91) & (codes <= 96)) | ((codes >= 123) & (codes <= 191))
    codes = np.where(gap, np.uint32(32), codes)
    parts, h = [], np.zeros(len(codes), np.uint32)
    inner = np.concatenate([[0], np.cumsum(gap)])
    with np.errstate(over="ignore"):
        for n in range(1, min(_LONGEST, len(codes)) + 1):
            h = (h[: len(codes) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            # Gaps may stand at the ends of a subword, not inside, and not alone.
            between = inner[n - 1 :][: len(h)] - inner[1 : len(h) + 1] if n > 2 else np.zeros(len(h), np.int64)
            ends = gap[: len(h)] & gap[n - 1 : n - 1 + len(h)] if n < 3 else np.zeros(len(h), bool)
            fits = (between == 0) & ~ends
            fits[: max(0, before - n + 1)] = False
            parts.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(12))[fits])
    return np.concatenate(parts).astype(np.int64)


def _stretches(text: str, rng: np.random.Generator) -> list[str]:
    """The words of a training text in stretches, short and long by turns, so that short inputs are learnt too."""
    words, out, at = text.split(), [], 0
    while at < len(words):
        size = 60 if len(out) % 2 else int(rng.integers(4, 15))
        out.append(" ".join(words[at : at + size]))
        at += size
    return [s for s in out if has_letter(s)]


def train(texts: list[str], labels: list[str], epochs: int = 2, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Fits embeddings and softmax by SGD on four fifths of the texts; the rest calibrates temperature and rejection."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((_BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, np.zeros(_CODES, bool), 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    back = set(order[len(order) * 4 // 5 :].tolist()) if len(order) > 4 else set()
    seen = np.zeros(_CODES, bool)
    # Buckets fit 16 bits, so that the sample's subwords take little of the driver's memory.
    learn: list[tuple[np.ndarray, int]] = []
    check: list[tuple[np.ndarray, int]] = []
    for i, text in enumerate(texts):
        for s in _stretches(text, rng):
            for codes in subwords(s):
                if not len(codes):
                    continue
                (check if i in back else learn).append(((codes >> _SHIFT).astype(np.uint16), languages.index(labels[i])))
                if i not in back:
                    seen[codes] = True
    check = check or learn
    table = rng.normal(0, 0.1, (_BUCKETS, _DIM)).astype(np.float32)
    weights, bias = np.zeros((_DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(len(learn)):
            ids, y = learn[i]
            mean = table[ids].mean(axis=0)
            p = _softmax(mean @ weights + bias)
            p[y] -= 1
            back_step = weights @ p
            weights -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            kinds, counts = np.unique(ids, return_counts=True)
            table[kinds] -= (step * 10 / len(ids)) * counts[:, None].astype(np.float32) * back_step
    logits = (table @ weights).astype(np.float32)
    scores = np.array([logits[ids].mean(axis=0) + bias for ids, _ in check]).reshape(-1, len(languages))
    truth = np.array([y for _, y in check], np.int64)
    losses = {t: -np.log(np.maximum(_softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in np.geomspace(0.05, 20, 49)} if len(truth) else {1.0: 0.0}
    model = LanguageModel(languages, logits, bias, float(min(losses, key=losses.get)), seen, 0.0)
    right = [c for i in back for name, _, c in [_judged(model, texts[i])] if name == labels[i]]
    model.threshold = float(_MARGIN * np.quantile(right, _LOST)) if right else 0.0
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _judged(model: LanguageModel, text: str | None) -> tuple[str, float, float]:
    """(language, calibrated probability, confidence) of a whole text; ``und`` and 0 without a letter."""
    if not has_letter(text) or not model.languages:
        return UNDETERMINED, 0.0, 0.0
    total, n, known = np.zeros(len(model.languages)), 0, 0
    for codes in subwords(text):
        total += np.take(model.logits, codes >> _SHIFT, axis=0).sum(axis=0, dtype=np.float64)
        known += int(model.seen[codes].sum())
        n += len(codes)
    p = _softmax((total / max(n, 1) + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best]), float(p[best]) * known / max(n, 1)


def predict(model: LanguageModel, text: str | None) -> tuple[str, float, bool]:
    """(language, calibrated probability, rejected) of a whole text; ``und`` and 0 without a letter."""
    name, p, confidence = _judged(model, text)
    return name, p, name == UNDETERMINED or confidence < model.threshold


def training_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS, least: int = LEAST_PER_LANGUAGE) -> list:
    """A bounded sample of labelled texts, about equally many a language, from the documents that may be learnt from.

    Of L languages each has at most ``per_language`` rows and at most rows / L, but ``least`` in any case: max(rows, L * least) rows
    reach the driver, and no language is left out. L is the number of classes, of which the model has a row each.
    """
    known = documents.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    drawn = (F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1_000_000)) / 1e6).cast("double")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(drawn).alias("first")).orderBy("lang").collect()
    if not counts:
        return []
    per_language = max(least, min(per_language, rows // len(counts)))
    # What is drawn of a language is a little more than it may have, and its first row at least, however often rows are repeated.
    shares = documents.sparkSession.createDataFrame([(r["lang"], max(r["first"], (1.5 * per_language + 10) / r["n"])) for r in counts], "lang string, share double")
    few = known.join(F.broadcast(shares), "lang").where(drawn <= F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id"))
    return few.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "text", "doc_id").orderBy("lang", "doc_id", F.xxhash64("text")).collect()


def train_on(documents: DataFrame, **settings) -> LanguageModel:
    rows = training_sample(documents)
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **settings)


def with_language(documents: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """documents with lang_pred, score and rejected. The model's size grows with the languages only; it is broadcast."""
    given = documents.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def make():
        own = given.value
        return lambda texts: [list(c) for c in zip(*[predict(own, t) for t in texts], strict=True)] if texts else [[], [], []]

    return append_columns(documents, ["text"], fields, make, keep)


def language_report(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, rejected.

    Null texts and texts without a letter get ``und``, score 0 and are rejected. Where nothing is labelled all are ``und``.
    Repeated rows are judged each; a null doc_id is not held out and never learnt from.
    """
    return with_language(documents.select("doc_id", "text"), train_on(documents), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
