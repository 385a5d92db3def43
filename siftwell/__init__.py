"""Search and analytics over semi-structured documents, as plans of PySpark."""
