"""The quality model's features, trees, pair cuts and scores against plain loops."""

import math
import random

import numpy as np
import pytest

from tablewright.llm import quality_gam as gam
from tests.llm.test_words import EDGES, prose

MARKS = "!?|#$%&*<>=@^~_.,;:\"'()[]{}/\\+-`"


def features_brute(text):
    """By characters and words of the text's bytes, one count after the other."""
    data = text.encode()
    w = [x for x in data.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ")
         .replace(b"\r", b" ").split(b" ") if x]
    if not w:
        return [0.0] * len(gam.FEATURES)
    held = sum(len(x) for x in w)

    def share(chars):
        return sum(data.count(c.encode()) for c in chars) / held

    lines = [x for x in data.split(b"\n") if x.strip()]
    triples = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    letters = [any(65 <= b <= 90 for b in x) and any(97 <= b <= 122 for b in x) for x in w]
    has_letter = [any(65 <= b <= 90 or 97 <= b <= 122 for b in x) for x in w]
    return [math.log(1 + len(w)), held / len(w), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("!?"), share("|"),
            share("#$%&*<>=@^~_"), share("."), share(",;:"), share("\"'()[]{}/\\+-`"), sum(b >= 128 for b in data) / held,
            len(set(w)) / len(w), max(w.count(x) for x in set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w),
            1 - len(set(triples)) / max(1, len(triples)) if len(w) > 2 else 0.0, 1 - len(set(lines)) / len(lines),
            len(w) / len(lines), sum(len(x) <= 3 for x in w) / len(w), sum(len(x) >= 12 for x in w) / len(w),
            sum(chr(x[-1]) in MARKS for x in w) / len(w), sum(h and not both for h, both in zip(has_letter, letters)) / len(w)]


def test_features():
    draw = random.Random(3)
    texts = [t or "" for _, t in EDGES] + [prose(k, 30) for k in range(5)]
    texts += ["".join(draw.choice("aB cé9!?|#.,;'\n\t \x0b_-`Zz") for _ in range(draw.randrange(400))) for _ in range(190)]
    for text in texts:
        assert gam.features_of(text) == pytest.approx(features_brute(text), abs=1e-12), text


def newton(g, h):
    return g * g / (h + gam.RIDGE)


def tree_brute(g, h, n, depth):
    """Leaf values of the best tree by trying every cut, the first of equals."""
    total = newton(sum(g), sum(h))
    cuts = []
    if depth and len(g) > 1:
        for k in range(1, len(g)):
            if min(sum(n[:k]), sum(n[k:])) >= gam.LEAST_LEAF:
                cuts.append((newton(sum(g[:k]), sum(h[:k])) + newton(sum(g[k:]), sum(h[k:])), k))
    if cuts:
        top = max(gain for gain, _ in cuts)
        if top > total + 1e-9:
            k = next(k for gain, k in cuts if gain >= top - 1e-12)
            return tree_brute(g[:k], h[:k], n[:k], depth - 1) + tree_brute(g[k:], h[k:], n[k:], depth - 1)
    return [sum(g) / (sum(h) + gam.RIDGE)] * len(g)


def test_tree():
    rng = np.random.default_rng(1)
    for _ in range(200):
        size = int(rng.integers(1, 12))
        n = rng.integers(0, 30, size)
        g, h = rng.normal(size=size) * n, rng.random(size) * n
        out = np.zeros(size)
        gam._tree(g, h, n, 0, size, 2, out)
        assert out.tolist() == pytest.approx(tree_brute(g.tolist(), h.tolist(), n.tolist(), 2))


def test_pair_cut():
    rng = np.random.default_rng(2)
    for _ in range(100):
        shape = tuple(rng.integers(1, 6, 2))
        n = rng.integers(0, 40, shape)
        g, h = rng.normal(size=shape) * n, rng.random(shape) * n
        found, best = [], (0.0, None)
        for i in range(1, shape[0]):
            for j in range(1, shape[1]):
                parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
                if min(n[p].sum() for p in parts) >= gam.LEAST_LEAF:
                    found.append((sum(newton(g[p].sum(), h[p].sum()) for p in parts) - newton(g.sum(), h.sum()), (i - 1, j - 1)))
        if found and max(found)[0] > 1e-9:
            best = max(found)
        gain, place, table = gam._quadrants(g, h, n)
        assert gain == pytest.approx(best[0], abs=1e-9) and place == best[1]
        if place:
            i, j = place[0] + 1, place[1] + 1
            assert table[0, 0] == pytest.approx(g[:i, :j].sum() / (h[:i, :j].sum() + gam.RIDGE))
            assert table[-1, -1] == pytest.approx(g[i:, j:].sum() / (h[i:, j:].sum() + gam.RIDGE))


def test_first_steps_and_score(monkeypatch):
    """Two cycles over two features, tables and scores by hand; then a score as a sum of lookups."""
    monkeypatch.setattr(gam, "ROUNDS", 2)
    monkeypatch.setattr(gam, "PAIRS", 0)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (200, 2)).astype(float)
    y = ((x[:, 0] > 2) ^ (rng.random(200) < 0.1)).astype(float)
    model = gam.fit(x, y)
    logit = np.full(200, math.log((y.sum() + 1) / (200 - y.sum() + 1)))
    for _ in range(2):
        for f in range(2):
            p = 1 / (1 + np.exp(-logit))
            bins = np.array([sum(e <= v for e in model.edges[f]) for v in x[:, f]])
            size = len(model.edges[f]) + 1
            sums = [[float(v[bins == b].sum()) for b in range(size)] for v in (y - p, p * (1 - p), np.ones(200))]
            step = np.array(tree_brute(*sums, 2))
            logit = logit + gam.RATE * step[bins]
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


def test_score_adds_lookups():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = gam.fit(x, y)
    assert model.pairs
    for row, got in zip(x, model.score(x)):
        logit = model.intercept
        for f in range(3):
            logit += model.tables[f][sum(e <= row[f] for e in model.edges[f])]
        for f, g, edges_f, edges_g, table in model.pairs:
            logit += table[sum(e <= row[f] for e in edges_f), sum(e <= row[g] for e in edges_g)]
        assert got == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-12)
