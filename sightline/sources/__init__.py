"""Readers and writers of documents, and adapters from the test tables."""
