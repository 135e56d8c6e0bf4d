"""quillspark: document-archive analytics as Spark jobs."""
