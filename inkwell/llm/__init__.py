"""Operators for preparing training data for language models.

Nothing outside this folder imports it; the entry module adds its queries only
when it is there.
"""
