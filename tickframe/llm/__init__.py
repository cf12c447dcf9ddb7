"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

One module per operator (general interface, real outputs) plus ``queries.py``,
which derives the registered ``opN_*`` digests from them. Nothing else in the
library imports this package.
"""
