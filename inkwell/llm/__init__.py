"""Training-data operators: deduplication, mixing, scoring, scanning, media, language and token columns.

Nothing else in the library imports this subpackage.
"""
