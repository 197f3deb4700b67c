from kiln.functions.arrays import (affine, argmax, array_sum, dot, lit_array, log_softmax,
                                   normalize, relu, scale, to_float32)
from kiln.functions.hashing import (seeded_hash32, seeded_key, seeded_uniform,
                                    sql_seeded_hash32, sql_seeded_uniform)

__all__ = ["affine", "argmax", "array_sum", "dot", "lit_array", "log_softmax", "normalize",
           "relu", "scale", "to_float32", "seeded_hash32", "seeded_key", "seeded_uniform",
           "sql_seeded_hash32", "sql_seeded_uniform"]
