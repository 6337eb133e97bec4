"""Operators over the documents of a training corpus. Nothing outside this package imports it."""
