"""Schema files, delimited text, the catalog and the benchmark generator."""
