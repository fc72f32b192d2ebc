"""Training-data operators: packing, token files, WARC, quality, deduplication, mixing, classifiers.

Nothing outside this folder imports it; each module holds one operator and states its null, empty
and tie rules in its docstrings.
"""
