"""Operators for preparing training text at scale, each with its registered query and SQL twin.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
