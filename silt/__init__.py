"""A PySpark engine for log-like text streams: split, mark, fold and render views."""
