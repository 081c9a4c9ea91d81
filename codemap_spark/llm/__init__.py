"""Training-data operators: scans, near-duplicates, search, mixing, token files.

Nothing outside this subpackage imports it.
"""
