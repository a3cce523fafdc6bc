"""Temperature and follow-the-leader on data whose answer is known."""

import numpy as np

from threadloom.llm.language_id import fit_ftrl, fit_temperature


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        f = np.array([i % 2, 2 + rng.integers(0, 50)])
        rows.append((i % 2, f, np.array([1.0, 1.0])))
    w = fit_ftrl(rows, 2, 60)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and (w[52:] == 0).all()


def test_temperature_of_overconfident_margins():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    m = np.zeros((2000, 2))
    m[np.arange(2000), np.where(rng.random(2000) < 0.8, y, 1 - y)] = 10.0
    assert fit_temperature(m, y) > 3
