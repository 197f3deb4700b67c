"""Numpy models evaluated inside Spark tasks.

A model is a plain object with a flat float64 parameter vector:

* ``init(seed) -> params``
* ``loss_grad(params, X, y, train, row_seeds) -> (loss_sum, grad_sum, n_correct)``
  where sums run over the rows of X (so partial results from many tasks add
  up exactly);
* ``scores(params, X)`` - logits (classification) or outputs (regression);
* ``inputs``, ``work``, ``row_bytes`` - input width, multiplications of a row's
  forward pass, and bytes a row takes while ``loss_grad`` runs.

Spark distributes the rows and adds the partial sums; the per-batch maths
here is deliberately small.  Initialisation follows the usual
U(-1/sqrt(fan_in), 1/sqrt(fan_in)) rule for weights and biases.
"""

from __future__ import annotations

import json

import numpy as np


def _uniform(rng, shape, fan_in):
    bound = 1.0 / np.sqrt(fan_in)
    return rng.uniform(-bound, bound, size=shape)


def head_loss(Z: np.ndarray, y: np.ndarray, task: str):
    """Loss sum, dLoss/dZ and number of correct predictions."""
    n = Z.shape[0]
    if task == "classification":
        yi = y.astype(np.int64)
        m = Z.max(axis=1, keepdims=True)
        lse = m + np.log(np.exp(Z - m).sum(axis=1, keepdims=True))
        logp = Z - lse
        loss = -logp[np.arange(n), yi].sum()
        dZ = np.exp(logp)
        dZ[np.arange(n), yi] -= 1.0
        correct = int((Z.argmax(axis=1) == yi).sum())
        return float(loss), dZ, correct
    diff = Z[:, 0] - y.astype(np.float64)
    return float((diff ** 2).sum()), (2.0 * diff)[:, None], 0


class _Packed:
    """Slicing of one flat parameter vector into named arrays."""

    shapes: list[tuple[str, tuple[int, ...], int]]

    def _layout(self, shapes):
        self.shapes = [(name, shape, fan) for name, shape, fan in shapes]
        self.n_params = int(sum(int(np.prod(s)) for _, s, _ in self.shapes))

    def unpack(self, params):
        out, pos = {}, 0
        for name, shape, _ in self.shapes:
            size = int(np.prod(shape))
            out[name] = params[pos:pos + size].reshape(shape)
            pos += size
        return out

    def pack(self, parts):
        return np.concatenate([parts[name].ravel() for name, _, _ in self.shapes])

    def init(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        return np.concatenate([_uniform(rng, shape, fan).ravel() for _, shape, fan in self.shapes])

    def config(self) -> dict:
        raise NotImplementedError

    def to_json(self) -> str:
        return json.dumps(self.config(), sort_keys=True)


class LinearNet(_Packed):
    """Affine map d -> k; softmax regression (classification) or linear
    regression (k = 1)."""

    def __init__(self, d: int, k: int = 1, task: str = "regression", zero_init: bool = False):
        self.d, self.k, self.task, self.zero_init = d, k, task, zero_init
        self.inputs, self.work, self.row_bytes = d, d * k, 8 * (d + 4 * k)
        self._layout([("W", (k, d), d), ("b", (k,), d)])

    def init(self, seed: int = 0):
        return np.zeros(self.n_params) if self.zero_init else super().init(seed)

    def config(self):
        return {"kind": "linear", "d": self.d, "k": self.k, "task": self.task, "zero_init": self.zero_init}

    def scores(self, params, X):
        p = self.unpack(params)
        return X @ p["W"].T + p["b"]

    def loss_grad(self, params, X, y, train=True, row_seeds=None):
        p = self.unpack(params)
        Z = X @ p["W"].T + p["b"]
        loss, dZ, correct = head_loss(Z, y, self.task)
        return loss, self.pack({"W": dZ.T @ X, "b": dZ.sum(axis=0)}), correct


class MLP(_Packed):
    """Fully connected ReLU network, e.g. 784-128-256-10."""

    def __init__(self, layers, task: str = "classification"):
        self.layers, self.task = [int(v) for v in layers], task
        self.inputs, self.row_bytes = self.layers[0], 32 * sum(self.layers)
        self.work = sum(a * b for a, b in zip(self.layers[:-1], self.layers[1:]))
        shapes = []
        for i, (a, b) in enumerate(zip(self.layers[:-1], self.layers[1:])):
            shapes += [(f"W{i}", (b, a), a), (f"b{i}", (b,), a)]
        self._layout(shapes)

    def config(self):
        return {"kind": "mlp", "layers": self.layers, "task": self.task}

    def _forward(self, p, X):
        acts, h = [X], X
        n_layers = len(self.layers) - 1
        for i in range(n_layers):
            z = h @ p[f"W{i}"].T + p[f"b{i}"]
            h = np.maximum(z, 0.0) if i < n_layers - 1 else z
            acts.append(h)
        return acts

    def scores(self, params, X):
        return self._forward(self.unpack(params), X)[-1]

    def loss_grad(self, params, X, y, train=True, row_seeds=None):
        p = self.unpack(params)
        acts = self._forward(p, X)
        loss, d, correct = head_loss(acts[-1], y, self.task)
        grads = {}
        for i in reversed(range(len(self.layers) - 1)):
            grads[f"W{i}"] = d.T @ acts[i]
            grads[f"b{i}"] = d.sum(axis=0)
            if i > 0:
                d = (d @ p[f"W{i}"]) * (acts[i] > 0)
        return loss, self.pack(grads), correct


def _im2col(X, k):
    """(n, C, H, W) -> (n, Ho, Wo, C*k*k)."""
    win = np.lib.stride_tricks.sliding_window_view(X, (k, k), axis=(2, 3))  # n,C,Ho,Wo,k,k
    n, C, Ho, Wo = win.shape[:4]
    return win.transpose(0, 2, 3, 1, 4, 5).reshape(n, Ho, Wo, C * k * k)


def _col2im(dcols, shape, k):
    n, C, H, W = shape
    Ho, Wo = H - k + 1, W - k + 1
    d6 = dcols.reshape(n, Ho, Wo, C, k, k)
    dX = np.zeros(shape)
    for i in range(k):
        for j in range(k):
            dX[:, :, i:i + Ho, j:j + Wo] += d6[:, :, :, :, i, j].transpose(0, 3, 1, 2)
    return dX


class SmallCNN(_Packed):
    """conv(1->16, 5) relu, conv(16->32, 3), max-pool 2, channel dropout
    0.25, linear(->10).  28x28 input gives the 3872-wide linear layer of the
    original network; 8x8 input gives 32."""

    def __init__(self, side: int = 28, c1: int = 16, c2: int = 32, k1: int = 5, k2: int = 3,
                 classes: int = 10, dropout: float = 0.25):
        self.side, self.c1, self.c2, self.k1, self.k2 = side, c1, c2, k1, k2
        self.classes, self.dropout = classes, dropout
        h2 = side - k1 + 1 - k2 + 1
        self.pooled = h2 // 2
        self.fc_in = c2 * self.pooled * self.pooled
        at1, at2 = (side - k1 + 1) ** 2, h2 * h2  # positions of the two convolutions
        self.inputs = side * side
        self.work = at1 * c1 * k1 * k1 + at2 * c2 * c1 * k2 * k2 + classes * self.fc_in
        # unfolded inputs (the second's gradient too), activations and their gradients
        self.row_bytes = 8 * (at1 * (k1 * k1 + 4 * c1) + at2 * (3 * c1 * k2 * k2 + 4 * c2))
        self.task = "classification"
        self._layout([("K1", (c1, 1, k1, k1), k1 * k1), ("c1", (c1,), k1 * k1),
                      ("K2", (c2, c1, k2, k2), c1 * k2 * k2), ("c2", (c2,), c1 * k2 * k2),
                      ("W", (classes, self.fc_in), self.fc_in), ("b", (classes,), self.fc_in)])

    def config(self):
        return {"kind": "cnn", "side": self.side, "c1": self.c1, "c2": self.c2, "k1": self.k1,
                "k2": self.k2, "classes": self.classes, "dropout": self.dropout}

    def _forward(self, p, X, train, row_seeds):
        n = X.shape[0]
        x0 = X.reshape(n, 1, self.side, self.side)
        cols1 = _im2col(x0, self.k1)
        z1 = (cols1 @ p["K1"].reshape(self.c1, -1).T + p["c1"]).transpose(0, 3, 1, 2)
        a1 = np.maximum(z1, 0.0)
        cols2 = _im2col(a1, self.k2)
        z2 = (cols2 @ p["K2"].reshape(self.c2, -1).T + p["c2"]).transpose(0, 3, 1, 2)
        hp = self.pooled
        crop = z2[:, :, :2 * hp, :2 * hp]
        win = crop.reshape(n, self.c2, hp, 2, hp, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, self.c2, hp, hp, 4)
        idx = win.argmax(axis=-1)
        pooled = np.take_along_axis(win, idx[..., None], axis=-1)[..., 0]
        if train and self.dropout > 0:
            keep = 1.0 - self.dropout
            mask = np.stack([np.random.default_rng(int(s)).random(self.c2) < keep for s in row_seeds])
            mask = mask.astype(np.float64) / keep
            dropped = pooled * mask[:, :, None, None]
        else:
            mask, dropped = None, pooled
        flat = dropped.reshape(n, -1)
        Z = flat @ p["W"].T + p["b"]
        cache = (x0, cols1, z1, a1, cols2, z2.shape, idx, mask, flat)
        return Z, cache

    def scores(self, params, X):
        return self._forward(self.unpack(params), X, False, None)[0]

    def loss_grad(self, params, X, y, train=True, row_seeds=None):
        p = self.unpack(params)
        if row_seeds is None:
            row_seeds = np.arange(X.shape[0])
        Z, (x0, cols1, z1, a1, cols2, z2_shape, idx, mask, flat) = self._forward(p, X, train, row_seeds)
        loss, dZ, correct = head_loss(Z, y, self.task)
        n, hp = X.shape[0], self.pooled
        g = {"W": dZ.T @ flat, "b": dZ.sum(axis=0)}
        dpool = (dZ @ p["W"]).reshape(n, self.c2, hp, hp)
        if mask is not None:
            dpool = dpool * mask[:, :, None, None]
        dwin = np.zeros((n, self.c2, hp, hp, 4))
        np.put_along_axis(dwin, idx[..., None], dpool[..., None], axis=-1)
        dz2 = np.zeros(z2_shape)
        dz2[:, :, :2 * hp, :2 * hp] = (dwin.reshape(n, self.c2, hp, hp, 2, 2).transpose(0, 1, 2, 4, 3, 5)
                                       .reshape(n, self.c2, 2 * hp, 2 * hp))
        d2 = dz2.transpose(0, 2, 3, 1).reshape(-1, self.c2)
        g["K2"] = (d2.T @ cols2.reshape(-1, cols2.shape[-1])).reshape(p["K2"].shape)
        g["c2"] = d2.sum(axis=0)
        dcols2 = d2 @ p["K2"].reshape(self.c2, -1)
        da1 = _col2im(dcols2, a1.shape, self.k2)
        dz1 = da1 * (z1 > 0)
        d1 = dz1.transpose(0, 2, 3, 1).reshape(-1, self.c1)
        g["K1"] = (d1.T @ cols1.reshape(-1, cols1.shape[-1])).reshape(p["K1"].shape)
        g["c1"] = d1.sum(axis=0)
        return loss, self.pack(g), correct


def build_model(config: dict | str):
    cfg = json.loads(config) if isinstance(config, str) else dict(config)
    kind = cfg.pop("kind")
    if kind == "linear":
        return LinearNet(**cfg)
    if kind == "mlp":
        return MLP(**cfg)
    if kind == "cnn":
        return SmallCNN(**cfg)
    raise ValueError(f"unknown model kind {kind!r}")
