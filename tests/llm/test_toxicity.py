"""The toxicity network against finite differences and a plain reading of every window."""

import random

import numpy as np
from ragloom.llm import toxicity


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial().items()}
    documents = [list(rng.choice(["ab", "cde", "f", "ghij", "x" * 40], n)) for n in (3, 30, 55, 24)]
    y = np.array([1.0, 0, 1, 0])
    _, g = toxicity.gradient(p, documents, y)
    for k, a in p.items():
        flat, i = a.ravel(), int(np.argmax(np.abs(g[k])))
        kept, losses = flat[i], []
        for step in (1e-2, -1e-2):
            flat[i] = kept + step
            losses.append(toxicity.gradient(p, documents, y)[0])
        flat[i] = kept
        assert abs((losses[0] - losses[1]) / 2e-2 - g[k].ravel()[i]) < 1e-3 * abs(g[k].ravel()[i]) + 1e-6, k


def test_gradient_does_not_depend_on_the_parts(monkeypatch):
    p, documents, y = toxicity.initial(), [["a", "bc"] * 60, ["d"] * 5, ["e", "a", "f"] * 30], np.array([1.0, 0, 0])
    whole = toxicity.gradient(p, documents, y)
    monkeypatch.setattr(toxicity.Layout, "parts", lambda self, most: ((at, min(at + 4, len(self.document) - self.tail)) for at in range(0, len(self.document) - self.tail, 4)))
    parts = toxicity.gradient(p, documents, y)
    assert abs(whole[0] - parts[0]) < 1e-6 and all(np.allclose(whole[1][k], parts[1][k], atol=1e-5) for k in p)


def plain_logit(p, words):
    """Windows one by one, units one by one."""

    def run(xs, u):
        h, state, out = u.shape[0], np.zeros(u.shape[0]), []
        for x in xs:
            ru = state @ u
            z, r = (1 / (1 + np.exp(-(x[i * h : i * h + h] + ru[i * h : i * h + h]))) for i in range(2))
            c = np.tanh(x[2 * h :] + r * ru[2 * h :])
            state = z * state + (1 - z) * c
            out.append(state)
        return out

    def vector(word):
        letters = [p["letters"][ord(c) % 1024] for c in word]
        ends = [run([x @ p[f"c{s}_w"] + p[f"c{s}_o"] for x in order], p[f"c{s}_u"])[-1] for s, order in (("f", letters), ("b", letters[::-1]))]
        return np.concatenate([p["words"][toxicity._word_bucket(word)], *ends])

    x, logits, start = [vector(w) for w in words], [], 0
    while True:
        part = x[start : start + toxicity.WINDOW]
        f = run([v @ p["f_w"] + p["f_o"] for v in part], p["f_u"])
        b = run([v @ p["b_w"] + p["b_o"] for v in part[::-1]], p["b_u"])[::-1]
        states = np.array([np.concatenate(s) for s in zip(f, b)])
        weight = np.exp((np.tanh(states @ p["att_w"]) @ p["att_v"])[:, 0])
        logits.append((weight / weight.sum()) @ states @ p["out_w"][:, 0] + p["out_o"][0])
        if start + toxicity.WINDOW >= len(words):
            return np.log(np.exp(logits).sum())
        start += toxicity.STRIDE


def test_scores_match_a_plain_reading_of_all_windows():
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (1, 5, 23, 24, 25, 30, 31, 90)]
    p = toxicity.initial()
    found = toxicity.Scorer(p).logits([*texts, None, ""])
    assert np.allclose(found[:-2], [plain_logit(p, t.split()) for t in texts], atol=0.02) and (found[-2:] == -9).all()
    assert np.allclose(found[:1], toxicity.Scorer(p).logits(texts[:1]), atol=1e-5)


def test_windows_cover_every_word():
    for n in range(1, 100):
        layout = toxicity.Layout([np.arange(n), np.arange(5)], 999)
        starts = np.flatnonzero(layout.document == 0) * toxicity.STRIDE
        assert starts[-1] + toxicity.WINDOW >= n and len(starts) == toxicity.windows_in(n)
        assert (layout.document == 1).sum() == 1 and layout.real.sum() == n + 5


def test_long_and_repeated_texts_are_learnt_from_and_bounded(spark):
    rng = random.Random(3)
    vocabulary = prose(rng, 150).split()
    texts = []
    for i in range(160):
        words = rng.choices(vocabulary, k=40 if i % 20 > 1 else 1700)
        if i % 2:
            for at in rng.sample(range(len(words)), 3):
                words[at] = rng.choice(["zqx", "zqy"])
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 300 + [(None, texts[1])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(None, 1)], "doc_id long, toxic int")
    sample, _ = toxicity.training_sample(docs, labels, 50)
    assert len(sample) == 50 and max(len(r["text"]) for r in sample) > 8000
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    right = [r["predicted"] == r["doc_id"] % 2 for r in got if r["held_out"]]
    assert np.mean(right) > 0.85
