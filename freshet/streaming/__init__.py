"""Structured-streaming variants of the batch operators."""
