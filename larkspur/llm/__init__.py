"""Training-data operators: tokenizing, formatting, scoring, scanning and deduplicating text.

Nothing outside this folder imports it.
"""
