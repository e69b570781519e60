"""Training-data operators: text quality, tokens, near-duplicates, mixing, search, chat.

Nothing else in the library imports this subpackage.
"""
