"""Training-data operators (chat formatting, WARC, de-duplication, packing ...).

Self-contained: nothing else in the library imports this subpackage.
"""
