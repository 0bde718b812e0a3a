"""Operators for training-data work: similarity, selection, splitting, duplication, tokens, leaks and truncation.

Nothing outside this folder imports it.
"""
