"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; its queries are in
``llm.queries`` and are added by ``__spark_entry__`` only where it exists.
"""
