"""Operators over collections of documents, as DataFrame transformations."""
