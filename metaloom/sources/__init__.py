"""Readers and writers: documents, ontologies, sample tables and annotations."""
