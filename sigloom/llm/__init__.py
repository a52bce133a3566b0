"""Operators for preparing training data: near-duplicates, PII, language ID,
tokenization, packing, template extraction, LM scoring and vector search.

Nothing outside this folder imports it; it can be removed as a whole.
"""
