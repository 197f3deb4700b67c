"""Operators for large training-data pipelines, one module each, and their
registered queries (``LLM_QUERIES``, ``LLM_ORACLES``)."""
