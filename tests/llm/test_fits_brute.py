"""The two fits against losses written out in plain Python."""

import math
import random

import numpy as np

from gatehouse.llm import quality, toxicity


def noisy_or_loss(bags, weights, bias, importance, l2):
    """Weighted mean of -log P(label), P(toxic) = 1 - prod over sentences of 1 - sigmoid(bias + weights of its features)."""
    total = sum(importance[b.label] for b in bags)
    loss = l2 / 2 * sum(w * w for w in weights)
    for b in bags:
        clean = 0.0
        for k in range(b.n_sentences):
            z = bias + sum(weights[f] for f, s in zip(b.feature, b.sentence, strict=True) if s == k)
            clean -= math.log1p(math.exp(z))
        loss -= importance[b.label] / total * (math.log(-math.expm1(clean)) if b.label else clean)
    return loss


def some_bags(seed):
    rng, bags = random.Random(seed), []
    for k in range(60):
        label, n = k % 2, rng.randint(1, 5)
        pairs = sorted({(rng.randrange(n), rng.randrange(4)) for _ in range(rng.randint(0, 6))} | ({(rng.randrange(n), 4)} if label and rng.random() < 0.8 else set()))
        bags.append(toxicity.Bag(label, np.array([f for _, f in pairs], np.int64), np.array([s for s, _ in pairs], np.int64), n))
    return bags


def test_the_noisy_or_fit_is_a_minimum_of_its_loss():
    bags, importance, l2 = some_bags(1), (3.0, 1.0), 1e-2
    model = toxicity.train(bags, np.arange(5), importance, steps=4000, l2=l2)
    at = [*model.weights[:5].tolist(), model.bias]
    loss = lambda p: noisy_or_loss(bags, p[:-1], p[-1], importance, l2)
    slope = lambda p, k, e=1e-5: (loss([x + e * (i == k) for i, x in enumerate(p)]) - loss([x - e * (i == k) for i, x in enumerate(p)])) / (2 * e)
    assert max(abs(slope(at, k)) for k in range(6)) < 2e-3
    assert loss(at) < loss([0.0] * 5 + [-6.0]) - 0.1
    assert model.weights[4] == max(model.weights[:5]) > 1


def test_the_first_step_follows_the_noisy_or_gradient():
    """Adam's first step is 0.1 against the sign of every slope."""
    bags, importance = some_bags(2), (1.0, 2.0)
    loss = lambda p: noisy_or_loss(bags, p[:-1], p[-1], importance, 0.0)
    start = [0.0] * 5 + [-6.0]
    slopes = [(loss([x + 1e-6 * (i == k) for i, x in enumerate(start)]) - loss([x - 1e-6 * (i == k) for i, x in enumerate(start)])) / 2e-6 for k in range(6)]
    model = toxicity.train(bags, np.arange(5), importance, steps=1, l2=0.0)
    moved = [*model.weights[:5].tolist(), model.bias + 6]
    assert all(abs(m + 0.1 * math.copysign(1, s)) < 1e-3 for m, s in zip(moved, slopes, strict=True) if abs(s) > 1e-5)


def risk(model, pos, unl, prior):
    """Non-negative unbiased risk with the logistic loss, row by row."""
    score = lambda row: model.bias + sum(model.weights[j][v] for j, v in enumerate(row))
    soft = lambda z: math.log1p(math.exp(-abs(z))) + max(z, 0)
    as_pos = sum(soft(-score(r)) for r in pos) / len(pos)
    rest = sum(soft(score(r)) for r in unl) / len(unl) - prior * sum(soft(score(r)) for r in pos) / len(pos)
    return prior * as_pos + max(rest, 0.0), rest


def test_the_positive_unlabelled_fit_lowers_its_risk_along_the_slope():
    rng = np.random.default_rng(3)
    features, bins = 3, quality.BINS
    unl = rng.integers(0, bins, (300, features))
    pos = np.minimum(rng.integers(0, bins, (80, features)) + bins // 3, bins - 1)
    model = quality.Model(np.zeros((features, bins - 1)), np.zeros((features, bins)), 0.0, 0.4)
    start = quality.Model(model.cuts, np.zeros((features, bins)), 0.0, 0.4)
    one = quality._descend(model, pos, unl, 1, 0.0, 0.4)
    assert risk(start, pos, unl, 0.4)[1] > 0
    for j in range(features):
        for v in range(bins):
            up, down = np.zeros((features, bins)), np.zeros((features, bins))
            up[j, v], down[j, v] = 1e-5, -1e-5
            slope = (risk(quality.Model(model.cuts, up, 0.0, 0.4), pos, unl, 0.4)[0] - risk(quality.Model(model.cuts, down, 0.0, 0.4), pos, unl, 0.4)[0]) / 2e-5
            if abs(slope) > 1e-5:
                assert abs(one.weights[j, v] + 0.1 * math.copysign(1, slope)) < 1e-3
    many = quality._descend(model, pos, unl, 400, 1e-4, 0.4)
    assert risk(many, pos, unl, 0.4)[0] < risk(start, pos, unl, 0.4)[0] - 0.05
    assert risk(many, pos, unl, 0.4)[1] > -0.05  # the negatives' part isn't driven below nothing
