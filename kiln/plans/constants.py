"""Parameters shared by the registered queries and their oracles."""

from __future__ import annotations

import math

SEED = 42
IMAGE_SIDE = 8          # embeddings: 64 floats = one 8x8 channel
N_CLASSES = 10
DIM = IMAGE_SIDE * IMAGE_SIDE


def rule_matrix(rows: int, cols: int, salt: float, scale: float = 1.0) -> list[list[float]]:
    """A deterministic weight matrix (6 decimals) used as a 'trained' model
    by the scoring and metric queries, so they are exact and repeatable."""
    return [[round(math.sin(salt + 1.7 * r + 0.37 * c) * scale, 6) for c in range(cols)]
            for r in range(rows)]


def rule_vector(n: int, salt: float, scale: float = 1.0) -> list[float]:
    return [round(math.cos(salt + 0.91 * i) * scale, 6) for i in range(n)]


# fixed-weight softmax classifier over the 64 embedding values
CLS_W = rule_matrix(N_CLASSES, DIM, 0.3, 2.0)
CLS_B = rule_vector(N_CLASSES, 0.7, 0.1)
# fixed linear scorer and SVM weights
LIN_W = rule_vector(DIM, 1.3, 0.5)
LIN_B = 0.05
SVM_REG = 0.1
# tiny fixed MLP 64 -> 6 -> 10
MLP_W1 = rule_matrix(6, DIM, 2.1, 1.5)
MLP_B1 = rule_vector(6, 2.9, 0.1)
MLP_W2 = rule_matrix(N_CLASSES, 6, 3.7, 1.0)
MLP_B2 = rule_vector(N_CLASSES, 4.1, 0.1)
