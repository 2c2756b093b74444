"""Spark jobs for preparing documents and answering questions over whole tables."""
