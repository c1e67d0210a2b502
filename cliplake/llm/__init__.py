"""Operators for preparing training text: near copies, filters, mixing, encoding.

Nothing else in the library imports this package. ``queries`` registers one query per
operator; ``corpus_pipeline`` at the repository top chains five of them.
"""
