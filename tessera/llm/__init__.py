"""Operators for large training-data corpora: scoring, filtering, near-duplicate search, mixing, encoding.

Nothing outside this subpackage imports it; ``queries`` holds what the repository's entry point registers.
"""
