"""Training-data operators: near-duplicate search, scoring, mixing, packing and archives.

Nothing outside this subpackage imports it.
"""
