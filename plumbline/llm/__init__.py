"""Training-data operators: packing, fingerprints, deduplication, joins, filters, tokenisation,
chat formatting, quality scoring and HTML extraction.

Nothing else in the library imports this subpackage.
"""
