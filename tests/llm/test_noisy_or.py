"""The noisy-or model against plain loops."""

import math
import random

import numpy as np
import pandas as pd

from souqlytics.llm import toxicity


def chance(x):
    return 1 / (1 + math.exp(-x))


def test_noisy_or_is_one_minus_the_product():
    rng = random.Random(1)
    p = [rng.random() for _ in range(30)]
    group = sorted(rng.randrange(7) for _ in range(30))
    got = toxicity.noisy_or(np.array(p), np.array(group), 8)
    for g in range(8):
        assert abs(got[g] - (1 - math.prod(1 - x for x, k in zip(p, group) if k == g))) < 1e-12


def test_training_follows_the_gradient():
    """Some steps of Adam whose gradients are taken by finite differences of the plain loss."""
    rng = random.Random(2)
    features, docs = 4, []
    for i in range(12):
        docs.append((i % 3 == 0, [sorted(rng.sample(range(features), rng.randint(0, 3))) for _ in range(rng.randint(1, 4))]))
    n, n1 = len(docs), sum(y for y, _ in docs)
    n0, decay, rate, steps = n - n1, 2e-5, 0.1, 6

    def loss(theta):
        *w, b = theta
        total = 0.0
        for y, sentences in docs:
            none = math.prod(1 - chance(b + sum(w[f] for f in s)) for s in sentences)
            weight = (1.0 if y else max(1.0, n0 / n1 / 2)) / n
            total -= weight * (math.log(1 - none) if y else math.log(none))
        return total + decay / 2 * sum(x * x for x in w)

    theta, m, v = [0.0] * features + [-6.0], [0.0] * (features + 1), [0.0] * (features + 1)
    for step in range(1, steps + 1):
        grad = []
        for i in range(features + 1):
            up, down = list(theta), list(theta)
            up[i] += 1e-5
            down[i] -= 1e-5
            grad.append((loss(up) - loss(down)) / 2e-5)
        m = [0.9 * a + 0.1 * g for a, g in zip(m, grad)]
        v = [0.999 * a + 0.001 * g * g for a, g in zip(v, grad)]
        theta = [t - rate * (a / (1 - 0.9**step)) / (math.sqrt(c / (1 - 0.999**step)) + 1e-8) for t, a, c in zip(theta, m, v)]
        theta[-1] = min(theta[-1], -2.0)

    rows = []
    for i, (y, sentences) in enumerate(docs):
        pairs = [(k, f) for k, s in enumerate(sentences) for f in s]
        rows.append((int(y), len(sentences), str(i), np.array(pairs, np.int32).reshape(-1, 2).T.copy().tobytes()))
    frame = pd.DataFrame(rows, columns=["y", "sentences", "id", "pairs"])
    model = toxicity._train(frame, np.arange(features, dtype=np.uint64), n1, n0, steps, rate, decay)
    assert np.allclose(np.append(model.weights, model.bias), theta, atol=1e-3)
