"""The class model against a plain one of the same classes, the exchange against full recounts, and defined cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DDL = "doc_id long, text string, score string, _kept int, word string"


def table(spark, texts, parts=3):
    return spark.createDataFrame([(k, t, "x", 1, "w") for k, t in enumerate(texts)], DDL).repartition(parts)


def made_up(n=120, seed=5):
    """Texts of two vocabularies, in which kinds of words alternate: classes have something to find."""
    rng = random.Random(seed)
    kinds = [[f"{a}{b}" for b in range(12)] for a in "abcd"]
    texts = []
    for k in range(n):
        pair = kinds[:2] if k % 2 else kinds[2:]
        texts.append(" ".join(rng.choice(pair[j % 2][: rng.choice((3, 12))]) for j in range(rng.randint(1, 40))))
    return texts + ["", None, " \t ", "Ébc ÉBC\x1cx odd", "once\x0bnever  a1", "a1 " * 3000, texts[0], texts[0]]


def plain_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0d]+", low), None]


def plain_scores(texts, learns, of, classes):
    """(n, per text (n_tokens, n_known, base, score)) for given classes of the words."""
    train = [plain_tokens(t) for t, yes in zip(texts, learns) if yes]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    cls = lambda w: "end" if w is None else of[w] if w in c else "new"
    words = [w for w in c if w is not None]
    n1, n2 = (sum(c[w] == x for w in words) for x in (1, 2))
    d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.05, 0.05), 0.9)
    size, types = Counter(), Counter()
    for w in words:
        size[of[w]] += c[w]
        types[of[w]] += 1
    size["end"] = c[None]
    follow = Counter()
    for t in train:
        for a, b in zip([None, *t], t):
            follow[cls(a), cls(b)] += 1
            if a is not None and c[a] == 1:
                follow["new", cls(b)] += 1
    kinds = [*[k for k in range(classes) if size[k]], "end", "new"]
    plain = {k: (size[k] + 0.5) / (sum(size.values()) + 0.5 * len(kinds)) for k in kinds}
    b1, b2 = (sum(x == y for x in follow.values()) for y in (1, 2))
    e = min(max(b1 / (b1 + 2 * b2) if b1 else 0.1, 0.1), 0.9)

    def after(a, b):
        total = sum(follow[a, k] for k in kinds)
        if not total:
            return plain[b]
        return max(follow[a, b] - e, 0) / total + e * sum(follow[a, k] > 0 for k in kinds) / total * plain[b]

    def prob(a, w):
        if w is None:
            return after(cls(a), "end")
        if w in c:
            return after(cls(a), of[w]) * (c[w] - d) / size[of[w]]
        return after(cls(a), "new") + sum(after(cls(a), k) * d * types[k] / size[k] for k in kinds if k not in ("end", "new"))

    if c:  # the distribution is whole
        for a in (None, words[0] if words else None, "never met"):
            assert sum(prob(a, w) for w in [*words, None, "never met"]) == pytest.approx(1)
    out = []
    for t in texts:
        w = plain_tokens(t)
        out.append((len(w), sum(x in c for x in w), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(prob(a, x)) for a, x in zip([None, *w], w))))
    return n, out


@pytest.mark.parametrize("share", [1e-9, 0.01, 0.9])
def test_scores_against_a_plain_model(spark, share):
    from tidemark.llm.brown import brown_scores

    texts = made_up()
    model, rows = brown_scores(table(spark, texts), F.col("doc_id") % 4 != 1, classes=6, share=share, sweeps=2)
    learns = [k % 4 != 1 for k in range(len(texts))]
    of = dict(zip(model.words.to_pylist(), model.of.tolist())) | {r["word"]: r["class"] for r in model.rare.collect()}
    n, want = plain_scores(texts, learns, of, model.classes)
    assert set(of) == {w for t, yes in zip(texts, learns) if yes for w in plain_tokens(t)} - {None}
    assert model.n == n and rows.columns == ["doc_id", "text", "_kept", "word", "n_tokens", "n_known", "base_score", "score"]
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in rows.collect()}
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        assert got[k][:2] == w[:2] and got[k][2:] == pytest.approx(w[2:])
    if share < 0.9:
        held = [k for k, yes in enumerate(learns[:120]) if not yes]
        assert sum(got[k][3] for k in held) > sum(got[k][2] for k in held) + 10


def test_exchange_moves_by_the_likelihood():
    from tidemark.llm.brown import Exchange, likelihood

    rng = np.random.default_rng(2)
    text, words, k = rng.integers(0, 15, 3000), 15, 4
    of = np.arange(words) % k

    def matrix(of):
        m, c = np.zeros((k + 2, k + 2)), np.concatenate([[k], of[text], [k]])
        np.add.at(m, (c[:-1], c[1:]), 1)
        return m

    for w in range(words):
        padded = np.concatenate([[-1], text, [-1]])
        here = np.flatnonzero(padded == w)
        cls = np.where(padded < 0, k, of[padded])
        left = np.bincount(cls[here - 1][padded[here - 1] != w], minlength=k + 2)
        right = np.bincount(cls[here + 1][padded[here + 1] != w], minlength=k + 2)
        state = Exchange(matrix(of), k)
        to = state.best(int(of[w]), left.astype(float), right.astype(float), float((padded[here - 1] == w).sum()))
        every = [likelihood(matrix(np.where(np.arange(words) == w, c, of))) for c in range(k)]
        assert every[to] == pytest.approx(max(every))
        of[w] = to
        assert np.allclose(state.m, matrix(of)) and np.allclose(state.out, matrix(of).sum(1)) and np.allclose(state.into, matrix(of).sum(0))


def test_exchange_rounds_raise_the_likelihood(spark, monkeypatch):
    from tidemark.llm import brown

    monkeypatch.setattr(brown, "BUCKET", 10)
    texts = table(spark, made_up(300)).select("text")
    model = brown.fit_words(texts, 4, 1e-9)
    encoded = brown.encode(texts, [], "text", model.words)
    worth = [brown.likelihood(brown.class_matrix(encoded, brown.exchanged(encoded, len(model.words), 4, s, 2), 4)) for s in (0, 1, 3)]
    assert worth[0] < worth[1] <= worth[2]
    of = dict(zip(model.words.to_pylist(), brown.exchanged(encoded, len(model.words), 4, 4, 2).tolist()))
    groups = [{of[w] for w in of if re.fullmatch(rf"{a}\d+", w) and w != "a1"} for a in "abcd"]
    assert sum(map(len, groups)) <= 8  # kinds of words fall into classes of their own, nearly


def test_nothing_to_learn_from(spark):
    from tidemark.llm.brown import brown_scores

    _, rows = brown_scores(table(spark, ["a b", None]), F.lit(False))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[0].n_tokens == 3 and got[0].n_known == 0 and got[0].base_score == 0 and got[0].score == pytest.approx(3 * math.log10(0.5))
    assert brown_scores(table(spark, []))[1].count() == 0
    _, rows = brown_scores(table(spark, ["", None]))
    assert all(r.n_known == r.n_tokens == 1 and math.isfinite(r.score) for r in rows.collect())


def test_op11_query(spark):
    import zlib

    from tidemark.llm.queries import QUERIES

    data = "/root/testdata/sf0.001"
    rows = QUERIES["op11_brown"](spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    held = {int(k): zlib.crc32(str(k).encode()) % 5 == 1 for k in docs.doc_id}
    assert len(rows) == len(docs) and all(held[k] == h for k, h in zip(rows.doc_id, rows.held_out))
    train = Counter(w for k, t in zip(docs.doc_id, docs.text) if not held[k] for w in plain_tokens(t))
    n = sum(train.values())
    assert (rows.train_tokens == n).all()
    texts = dict(zip(docs.doc_id, docs.text))
    for r in rows.itertuples():
        w = plain_tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(w), sum(x in train for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (len(train) + 1))) for x in w))
    assert rows[rows.held_out].score.sum() > rows[rows.held_out].base_score.sum()
