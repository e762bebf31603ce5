"""Spark jobs over large collections of sensitive documents: copies, redaction, linkage, catalogue, search."""
