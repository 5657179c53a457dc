"""Column-level helpers: type vocabulary, statistics expressions, scalar repairs."""
