"""A PySpark analytics engine for corpora of documents and their reviews."""
