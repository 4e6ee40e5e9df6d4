"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words, trained in numpy.

A word's input is a hashed word embedding and the two end states of a character-level recurrence over its letters; words are
read once and remembered by their input projections. Each overlapping window of words is read in both directions, pooled by
attention and scored; a document's score pools the scores of all its windows, in training as in scoring.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import append_columns, held_out, learnable

#: Words a window, and words between the starts of windows: a quarter, so a span of up to 18 words lies whole in some window.
WINDOW, STRIDE = 24, 6
#: Labelled documents that training takes at most, half of each label where there are enough. Their texts are taken whole.
SAMPLE_DOCUMENTS = 2400
_LETTERS = 1024
_CHAR_DIM, _CHAR_STATE, _WORD_DIM, _STATE = 8, 10, 6, 6
_WORD_BUCKETS = 1 << 14
#: Letters of a word that are read (a longer word is read in pieces of this size, and the pieces' states are averaged).
_PIECE = 24
#: Words that are remembered at most, and their letters.
_MEMORY, _MEMORY_LETTERS = 400_000, 8_000_000
#: Windows that are read together.
_TOGETHER = 640
#: Input of the update gate that leaves a state as it is: what stands for padding.
_SHUT = np.float32(30)
#: Scorers of this Python worker by their network's checksum, so that tasks share what is remembered; only the last is kept.
_scorers: dict[int, Scorer] = {}
_WORD = re.compile(r"\w+|[^\w\s]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale=None: (rng.normal(0, scale or 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
    x = _WORD_DIM + 2 * _CHAR_STATE
    p = {"letters": draw(_LETTERS, _CHAR_DIM, scale=0.3), "words": draw(_WORD_BUCKETS, _WORD_DIM, scale=0.05)}
    for side in ("f", "b"):
        p |= {f"c{side}_w": draw(_CHAR_DIM, 3 * _CHAR_STATE), f"c{side}_u": draw(_CHAR_STATE, 3 * _CHAR_STATE), f"c{side}_o": np.zeros(3 * _CHAR_STATE, np.float32)}
        p |= {f"{side}_w": draw(x, 3 * _STATE), f"{side}_u": draw(_STATE, 3 * _STATE), f"{side}_o": np.zeros(3 * _STATE, np.float32)}
    return p | {"att_w": draw(2 * _STATE, _STATE), "att_v": draw(_STATE, 1), "out_w": draw(2 * _STATE, 1), "out_o": np.full(1, -3, np.float32)}


def squash(x: np.ndarray) -> np.ndarray:
    """tanh in place, as a ratio of polynomials (within 0.002), which costs a third of numpy's."""
    s = x * x
    low = s * np.float32(15)
    low += np.float32(420)
    low *= s
    low += np.float32(945)
    top = s + np.float32(105)
    top *= s
    top += np.float32(945)
    x *= top
    x /= low
    np.minimum(x, np.float32(1), out=x)
    return np.maximum(x, np.float32(-1), out=x)


def gru(inputs: Iterable[np.ndarray], n: int, u: np.ndarray, keep: bool = False, into: Iterable[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
    """Runs a gated recurrent unit over projected inputs, one array (3h, n) a step, those of the gates halved: (last state (h, n), what the way back needs if ``keep``).

    The state of every step is written to ``into`` if given.
    """
    h, half, across = u.shape[0], np.float32(0.5), np.ascontiguousarray(u.T)
    across[: 2 * h] *= half
    state, saved = np.zeros((h, n), np.float32), []
    for x, out in zip(inputs, into if into is not None else repeat(None)):
        r_u = across @ state
        zr = r_u[: 2 * h] + x[: 2 * h]
        squash(zr)
        zr *= half
        zr += half
        z, r = zr[:h], zr[h:]
        c = r * r_u[2 * h :]
        c += x[2 * h :]
        squash(c)
        new = np.subtract(state, c, out=out)
        new *= z
        new += c
        if keep:
            saved.append((state, z, r, c, r_u[2 * h :]))
        state = new
    return state, saved


def gru_back(d_states: list[np.ndarray | None], saved: list, u: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(gradients of the projected inputs, gradient of u). Padding gets none: its gate is shut."""
    h, n = saved[0][0].shape
    d_in, d_u, d = [None] * len(saved), np.zeros_like(u), np.zeros((h, n), np.float32)
    for t in range(len(saved) - 1, -1, -1):
        state, z, r, c, ru = saved[t]
        if d_states[t] is not None:
            d = d + d_states[t]
        dc = d * (1 - z) * (1 - c * c)
        d_in[t] = np.concatenate([d * (state - c) * z * (1 - z), dc * ru * r * (1 - r), dc])
        part = d_in[t].copy()
        part[2 * h :] *= r
        d_u += state @ part.T
        d = d * z + u @ part
    return d_in, d_u


def _with_padding(projected: np.ndarray) -> np.ndarray:
    """Projected inputs (n, 3h) as columns, the gates' halved for ``gru``, and a last column for padding."""
    out = np.zeros((projected.shape[1], len(projected) + 1), np.float32)
    gates = projected.shape[1] // 3 * 2
    out[:, :-1] = projected.T
    out[:gates] *= np.float32(0.5)
    out[: gates // 2, -1] = _SHUT
    return out


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of the words' pieces, a step a row and padded with _LETTERS; word of each piece)."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        for at in range(0, len(w), _PIECE):
            pieces.append(w[at : at + _PIECE])
            owner.append(i)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    mask = np.arange(lengths.max() if len(pieces) else 1) < lengths[:, None]
    letters = np.full(mask.shape, _LETTERS, np.int64)
    letters[mask] = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32) % _LETTERS
    return np.ascontiguousarray(letters.T), np.array(owner, np.int64)


def _word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % _WORD_BUCKETS


def word_inputs(p: dict, words: list[str], keep: bool = False):
    """Input vectors (n, word + 2 char states) of distinct words."""
    letters, owner = _spelled(words)
    pieces = np.bincount(owner, minlength=len(words)).astype(np.float32)[:, None]
    sides, saved = [], []
    for side in ("f", "b"):
        # Backwards, the padding comes first and leaves the state at zero.
        steps = letters if side == "f" else letters[::-1]
        projected = _with_padding(p["letters"] @ p[f"c{side}_w"] + p[f"c{side}_o"])
        last, kept = gru((projected.take(x, axis=1) for x in steps), letters.shape[1], p[f"c{side}_u"], keep)
        last = last.T
        if len(owner) != len(words):
            total = np.zeros((len(words), _CHAR_STATE), np.float32)
            np.add.at(total, owner, last)
            last = total / pieces
        sides.append(last)
        saved.append((steps, kept))
    buckets = np.array([_word_bucket(w) for w in words], np.int64)
    out = np.concatenate([p["words"][buckets], *sides], axis=1)
    return (out, (owner, pieces, buckets, saved)) if keep else out


def word_inputs_back(p: dict, g: dict, d: np.ndarray, kept: tuple) -> None:
    owner, pieces, buckets, saved = kept
    np.add.at(g["words"], buckets, d[:, :_WORD_DIM])
    for k, side in enumerate(("f", "b")):
        steps, states = saved[k]
        last = (d[:, _WORD_DIM + k * _CHAR_STATE : _WORD_DIM + (k + 1) * _CHAR_STATE] / pieces)[owner]
        d_in, d_u = gru_back([*[None] * (len(steps) - 1), last.T], states, p[f"c{side}_u"])
        d_projected = _summed(steps.ravel(), np.concatenate(d_in, axis=1).T, _LETTERS + 1)[:_LETTERS]
        g[f"c{side}_u"] += d_u
        g[f"c{side}_o"] += d_projected.sum(axis=0)
        g[f"c{side}_w"] += p["letters"].T @ d_projected
        g["letters"] += d_projected @ p[f"c{side}_w"].T


def _summed(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows by id, by one sort."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(ids):
        order = np.argsort(ids, kind="stable")
        kinds, starts = np.unique(ids[order], return_index=True)
        out[kinds] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def windows_in(n: int) -> int:
    """Overlapping windows over n words; the last may be padded."""
    return max(0, -(-(n - WINDOW) // STRIDE)) + 1 if n else 0


class Layout:
    """Words of several documents in one array, each document padded to whole windows; windows start at every block of STRIDE.

    The blocks in which a document's last window ends start no window of their own (``document`` is -1 there).
    """

    def __init__(self, documents: list[np.ndarray], padding: int) -> None:
        tail = WINDOW // STRIDE - 1
        parts, document = [], []
        for k, ids in enumerate(documents):
            n = windows_in(len(ids))
            if n:
                parts.append(np.concatenate([ids, np.full((n + tail) * STRIDE - len(ids), padding, np.int64)]))
                document.append(np.concatenate([np.full(n, k), np.full(tail, -1)]))
        self.ids = np.concatenate(parts).reshape(-1, STRIDE) if parts else np.zeros((0, STRIDE), np.int64)
        self.document = np.concatenate(document) if parts else np.zeros(0, np.int64)
        self.real = self.ids != padding
        self.tail = tail

    def columns(self, projected: np.ndarray) -> np.ndarray:
        """Projected inputs (3h, words) of all words: (STRIDE, 3h, blocks)."""
        return np.stack([projected.take(ids, axis=1) for ids in self.ids.T])

    def parts(self, most: int = _TOGETHER) -> Iterator[tuple[int, int]]:
        """Ranges of window starts."""
        for at in range(0, len(self.document) - self.tail, most):
            yield at, min(at + most, len(self.document) - self.tail)


def _steps(blocks: np.ndarray, at: int, end: int) -> list[np.ndarray]:
    """Columns of the windows that start at blocks at..end, word by word: views, nothing is gathered."""
    return [blocks[t % STRIDE][..., at + t // STRIDE : end + t // STRIDE] for t in range(WINDOW)]


def window_logits(p: dict, forward: np.ndarray, backward: np.ndarray, real: np.ndarray, at: int, end: int, keep: bool = False):
    """Logit of each window that starts at blocks at..end, from its words' projected inputs (STRIDE, 3h, blocks)."""
    n = end - at
    states = np.empty((WINDOW, 2 * _STATE, n), np.result_type(forward, p["f_u"]))
    _, kept_f = gru(_steps(forward, at, end), n, p["f_u"], keep, states[:, :_STATE])
    _, kept_b = gru(_steps(backward, at, end)[::-1], n, p["b_u"], keep, states[::-1, _STATE:])
    hidden = squash(p["att_w"].T @ states)
    weight = (p["att_v"].T @ hidden)[:, 0]
    weight[~np.stack(_steps(real.T, at, end))] = -1e9
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("thn,tn->hn", states, weight)
    logits = (p["out_w"].T @ pooled)[0] + p["out_o"]
    return (logits, (kept_f, kept_b, states, hidden, weight, pooled)) if keep else logits


def window_logits_back(p: dict, g: dict, d: np.ndarray, kept: tuple) -> tuple[list, list]:
    kept_f, kept_b, states, hidden, weight, pooled = kept
    g["out_w"] += pooled @ d[:, None]
    g["out_o"] += d.sum(keepdims=True)
    d_pooled = p["out_w"] * d
    d_weight = np.einsum("thn,hn->tn", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["att_v"] += np.einsum("thn,tn->h", hidden, d_score)[:, None]
    d_hidden = d_score[:, None] * p["att_v"] * (1 - hidden * hidden)
    g["att_w"] += (states @ d_hidden.transpose(0, 2, 1)).sum(axis=0)
    d_states = weight[:, None] * d_pooled + p["att_w"] @ d_hidden
    d_f, d_uf = gru_back(list(d_states[:, :_STATE]), kept_f, p["f_u"])
    d_b, d_ub = gru_back(list(d_states[::-1, _STATE:]), kept_b, p["b_u"])
    g["f_u"] += d_uf
    g["b_u"] += d_ub
    return d_f, d_b[::-1]


def pool(logits: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """Logit of each document: log-sum-exp of its windows' logits, which a single toxic window can carry."""
    top = np.full(n, -np.inf, np.float64)
    np.maximum.at(top, document, logits)
    total = np.zeros(n)
    np.add.at(total, document, np.exp(logits - top[document]))
    return np.where(np.isfinite(top), top + np.log(np.maximum(total, 1e-30)), -9.0)


def gradient(p: dict, documents: list[list[str]], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean binary cross-entropy, gradient) of whole documents. Windows are read in parts of bounded size."""
    g = {k: np.zeros_like(a) for k, a in p.items()}
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in d], np.int64) for d in documents]
    layout = Layout(ids, len(vocabulary))
    # Words of like length are spelled together, so that little padding is read.
    words = list(vocabulary)
    by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
    spelled = [by_length[i : i + 600] for i in range(0, len(by_length), 600)]
    x, kept_words = np.empty((len(words), _WORD_DIM + 2 * _CHAR_STATE), np.float32), []
    for part in spelled:
        x[part], kept = word_inputs(p, [words[i] for i in part], True)
        kept_words.append(kept)
    forward, backward = (layout.columns(_with_padding(x @ p[f"{s}_w"] + p[f"{s}_o"])) for s in "fb")
    parts = list(layout.parts(4 * _TOGETHER))
    logits, held = np.zeros(len(layout.document)), None
    for at, end in parts:
        out = window_logits(p, forward, backward, layout.real, at, end, len(parts) == 1)
        logits[at:end], held = out if len(parts) == 1 else (out, None)
    own = layout.document >= 0
    scores = pool(logits[own], layout.document[own], len(documents))
    d_doc = (1 / (1 + np.exp(-scores)) - y) / len(documents)
    d = np.zeros(len(logits))
    d[own] = (d_doc[layout.document] * np.exp(np.minimum(logits - scores[layout.document], 0)))[own]
    d_f, d_b = np.zeros_like(forward), np.zeros_like(backward)
    for at, end in parts:
        if np.abs(d[at:end]).max() < 1e-9:
            continue
        kept = held or window_logits(p, forward, backward, layout.real, at, end, True)[1]
        for side, found in zip((d_f, d_b), window_logits_back(p, g, d[at:end].astype(np.float32), kept), strict=True):
            for into, one in zip(_steps(side, at, end), found, strict=True):
                into += one
    d_x = np.zeros_like(x)
    for s, side in zip("fb", (d_f, d_b), strict=True):
        d_p = _summed(layout.ids.T.ravel(), side.transpose(0, 2, 1).reshape(-1, side.shape[1]), len(words) + 1)[:-1]
        g[f"{s}_w"], g[f"{s}_o"] = x.T @ d_p, d_p.sum(axis=0)
        d_x += d_p @ p[f"{s}_w"].T
    for part, kept in zip(spelled, kept_words, strict=True):
        word_inputs_back(p, g, d_x[part], kept)
    return float(np.mean(np.logaddexp(0, scores) - y * scores)), g


def train(texts: list[str], labels: list[int], epochs: int = 4, least_steps: int = 400, batch: int = 12, rate: float = 0.006, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam on the binary cross-entropy of document scores, over all windows. A small sample is visited more often, until ``least_steps``."""
    p = initial(seed)
    if not texts or len(set(labels)) < 2:
        return p
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    y = np.array(labels, np.float64)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    epochs = max(epochs, -(-least_steps // -(-len(texts) // batch)))
    total_steps = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = [i for i in order[at : at + batch] if split[i]]
            if not chosen:
                continue
            _, g = gradient(p, [split[i] for i in chosen], y[chosen])
            step += 1
            now = rate * (1 - 0.9 * step / total_steps)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a *= min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return p


class Scorer:
    """Scores texts with a trained network, remembering the input vectors of words."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p, self.known, self.letters = p, {}, 0
        self.inputs = np.zeros((_MEMORY, _WORD_DIM + 2 * _CHAR_STATE), np.float32)

    def _learn(self, words: list[str]) -> None:
        if len(words) > len(self.inputs):
            self.inputs = np.zeros((len(words), self.inputs.shape[1]), np.float32)
        words = sorted(words, key=len)
        self.letters += sum(map(len, words))
        for at in range(0, len(words), 1000):
            part, begin = words[at : at + 1000], len(self.known)
            self.inputs[begin : begin + len(part)] = word_inputs(self.p, part)
            self.known.update(zip(part, range(begin, begin + len(part)), strict=True))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Document logits: windows of several documents are read together."""
        out, group, size = np.full(len(texts), -9.0), [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                group.append((i, words))
                size += len(words)
            if size > 20_000:
                self._flush(group, out)
                group, size = [], 0
        self._flush(group, out)
        return out

    def _flush(self, group: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        if not group:
            return
        missing = {w for _, words in group for w in words if w not in self.known}
        if missing:
            if len(self.known) + len(missing) > len(self.inputs) or self.letters > _MEMORY_LETTERS:
                self.known.clear()
                self.letters = 0
                missing = {w for _, words in group for w in words}
            self._learn(list(missing))
        ids = np.fromiter((self.known[w] for _, words in group for w in words), np.int64, sum(len(words) for _, words in group))
        kinds, ids = np.unique(ids, return_inverse=True)
        x = self.inputs[kinds]
        layout = Layout(np.split(ids, np.cumsum([len(words) for _, words in group])[:-1]), len(kinds))
        forward, backward = (layout.columns(_with_padding(x @ self.p[f"{s}_w"] + self.p[f"{s}_o"])) for s in "fb")
        logits = np.zeros(len(layout.document))
        for at, end in layout.parts():
            logits[at:end] = window_logits(self.p, forward, backward, layout.real, at, end)
        own = layout.document >= 0
        out[[i for i, _ in group]] = pool(logits[own], layout.document[own], len(group))


def training_sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCUMENTS) -> tuple[list, float]:
    """A bounded sample (text, toxic) of rows that may be learnt from, half of each label where there are enough.

    Also the shift of the logit from the sample's share of toxic documents to that of all labels that may be learnt from. At most
    2 * ``most`` rows reach the driver, however often a doc_id is repeated.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").where(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64("doc_id")
    picks = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(key, "doc_id").limit(most)
        picks = part if picks is None else picks.unionByName(part)
    texts = documents.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(picks), "doc_id")  # at most 2 * most ids
    rows = [r for label in (0, 1) for r in texts.where(F.col("toxic") == label).orderBy(key, "doc_id", F.xxhash64("text")).limit(most).collect()]
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["text"]))
    toxic = [r for r in rows if r["toxic"]][: most // 2]
    clean = [r for r in rows if not r["toxic"]][: most - len(toxic)]
    all_toxic, all_rows = known.agg(F.sum("toxic"), F.count("*")).first()
    if not toxic or not clean:
        return [], 0.0
    return toxic + clean, float(np.log(all_toxic / (all_rows - all_toxic)) - np.log(len(toxic) / len(clean)))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Null and empty texts score near 0 like any text without words. Repeated rows are scored each. A null doc_id is not held out
    and never learnt from. Without labels of both kinds the untrained network's low prior is returned.
    """
    rows, shift = training_sample(documents.select("doc_id", "text"), labels)
    given = documents.sparkSession.sparkContext.broadcast(train([r["text"] for r in rows], [r["toxic"] for r in rows]))

    def make():
        mark = zlib.crc32(b"".join(a.tobytes() for a in given.value.values()))
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(given.value)
        scorer = _scorers[mark]
        return lambda texts: [(1 / (1 + np.exp(-(scorer.logits(texts) + shift)))).tolist()]

    scored = append_columns(documents.select("doc_id", "text"), ["text"], [T.StructField("score", T.DoubleType())], make, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
