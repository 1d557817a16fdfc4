"""Operators for preparing training corpora, each with a thin contract query.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
