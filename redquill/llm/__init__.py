"""Training-data operators: packing, classification, deduplication, mixing, chat, secrets and media.

Nothing else in the library imports this package.
"""
