"""Operators for large training-data pipelines over documents, pages,
conversations and embeddings. Nothing else in the library imports this
subpackage; ``queries.py`` lists its registered queries."""
