"""Operators of a training-data pipeline over document, page and benchmark tables.

Nothing outside this package imports it. ``queries`` registers one query per
operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
