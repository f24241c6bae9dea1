"""Operators for building language-model training corpora.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
