"""Incremental variants of batch operators."""
