"""Exact checks of the numpy models: gradients against central differences,
optimizer steps against hand-computed values."""

import numpy as np
import pytest

from kiln.models import MLP, Adam, LinearNet, SmallCNN, build_model


def _numeric_grad(model, params, X, y, seeds, eps=1e-6):
    g = np.zeros_like(params)
    for i in range(params.size):
        p1, p2 = params.copy(), params.copy()
        p1[i] += eps
        p2[i] -= eps
        g[i] = (model.loss_grad(p1, X, y, True, seeds)[0] - model.loss_grad(p2, X, y, True, seeds)[0]) / (2 * eps)
    return g


@pytest.mark.parametrize("model,d,task", [
    (LinearNet(5, 3, "classification"), 5, "classification"),
    (LinearNet(4, 1, "regression"), 4, "regression"),
    (MLP([6, 5, 4, 3]), 6, "classification"),
    (MLP([4, 3, 1], task="regression"), 4, "regression"),
    (SmallCNN(side=8, c1=2, c2=3), 64, "classification"),
])
def test_gradient_matches_central_differences(model, d, task):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(7, d))
    y = rng.integers(0, 3, size=7) if task == "classification" else rng.normal(size=7)
    params = model.init(1)
    seeds = np.arange(7) + 100
    loss, grad, _ = model.loss_grad(params, X, y, True, seeds)
    num = _numeric_grad(model, params, X, y, seeds)
    assert np.allclose(grad, num, rtol=1e-4, atol=1e-6)


def test_cnn_shapes_match_original_network():
    assert SmallCNN(side=28).fc_in == 3872
    assert SmallCNN(side=8).fc_in == 32
    assert MLP([784, 128, 256, 10]).n_params == 784 * 128 + 128 + 128 * 256 + 256 + 256 * 10 + 10


def test_config_round_trip():
    for m in (LinearNet(3, 2, "classification"), MLP([4, 5, 2]), SmallCNN(side=8)):
        assert build_model(m.to_json()).config() == m.config()


def test_adam_first_step_is_lr_times_sign():
    opt = Adam(lr=0.1)
    out = opt.step(np.array([1.0, -2.0]), np.array([0.5, -3.0]))
    assert np.allclose(out, [0.9, -1.9], atol=1e-6)


def test_zero_softmax_loss_is_log_k():
    m = LinearNet(4, 10, "classification", zero_init=True)
    loss, _, _ = m.loss_grad(m.init(), np.ones((3, 4)), np.array([0, 1, 2]))
    assert loss / 3 == pytest.approx(np.log(10))
