"""Training-data operators: one module per operator, shared numpy kernels, and their queries.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
