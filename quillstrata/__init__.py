"""Quillstrata: a PySpark-native engine for chunking, versioning and indexing text."""
