"""Quillmark: analytics over controlled documents, conversation logs and training corpora, as Spark jobs."""
