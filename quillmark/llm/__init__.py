"""Training-data operators: scoring, dedup, tokenising, search and mixing.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
